"""Limits, queues, leases and liveness as batch windows over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_limit(events: DataFrame, tenant: str, ts: str, tie: str, seconds: int, most: int) -> DataFrame:
    """n events of the tenant in the window up to each one; limited and retry_after (1 s at least) beyond."""
    w = Window.partitionBy(tenant).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    out = events.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_oldest", F.min(F.unix_micros(ts)).over(w))
    wait = F.greatest(F.lit(1), F.ceil((F.col("_oldest") + seconds * 1_000_000 - F.unix_micros(ts)) / 1_000_000))
    return out.withColumn("limited", F.col("n") >= most).withColumn("retry_after", F.when(F.col("limited"), wait)).drop("_oldest")


def month_quota(events: DataFrame, tenant: str, ts: str, quota: int) -> DataFrame:
    """Events of each tenant and calendar month against a quota, with the start of the next month."""
    month = F.date_trunc("month", F.col(ts))
    g = events.groupBy(tenant, month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("exhausted", F.col("n") >= quota).withColumn("next_month", F.add_months(F.to_date("month"), 1))


def fair_claim(jobs: DataFrame, tenant: str, order: list[str], active: DataFrame, cap: int, claims: int) -> DataFrame:
    """The jobs that claimers take one after another: first in, first out, at most cap active ones of
    a tenant, counting those that run already. active: tenant, running."""
    turn = F.row_number().over(Window.partitionBy(tenant).orderBy(*order))
    j = jobs.join(active, tenant, "left").withColumn("_turn", turn + F.coalesce("running", F.lit(0))).filter(F.col("_turn") <= cap)
    return j.orderBy(*order).limit(claims).drop("_turn", "running")


def claim_oldest(jobs: DataFrame, tenant: str, order: list[str], active: DataFrame, cap: int, claims: int, look: int = 100) -> DataFrame:
    """What `claims` claimers take one after another, each the first of the `look` oldest queued jobs whose tenant has
    less than `cap` active ones. A job that is passed over stays one of the oldest: after `look` such jobs nothing is
    found any more. Only the `look` + `claims` oldest can matter, and only those go through one task."""
    oldest = jobs.orderBy(*order).limit(look + claims)
    turn = F.row_number().over(Window.partitionBy(tenant).orderBy(*order)) + F.coalesce("running", F.lit(0))
    fits = oldest.join(active, tenant, "left").withColumn("_fits", turn <= cap)
    queue = Window.orderBy(*order)
    fits = fits.withColumns({"_passed": F.sum((~F.col("_fits")).cast("int")).over(queue), "_taken": F.sum(F.col("_fits").cast("int")).over(queue)})
    return fits.filter("_fits").filter((F.col("_passed") < look) & (F.col("_taken") <= claims)).drop("running", "_fits", "_passed", "_taken")


def lease_state(events: DataFrame, key: str, order: list[str], kind: str, ts: str, lease: int) -> DataFrame:
    """Folds each key's events in order: a lease is given when there is none or it has run out, and
    raises the generation; it is used up only while it runs. Adds generation, leased, used at the end.
    """
    seq = F.array_sort(F.collect_list(F.struct(*order, F.unix_micros(ts).alias("t"), F.col(kind).alias("k"))))
    zero = F.struct(F.lit(0).alias("generation"), F.lit(None).cast("long").alias("until"), F.lit(False).alias("used"))

    def step(s, e):
        free = s["until"].isNull() | (s["until"] <= e["t"])
        give = (e["k"] == "lease") & free & ~s["used"]
        use = (e["k"] == "use") & ~free
        return F.struct((s["generation"] + give.cast("int")).alias("generation"), F.when(give, e["t"] + lease * 1_000_000).otherwise(s["until"]).alias("until"), (s["used"] | use).alias("used"))

    return events.groupBy(key).agg(F.aggregate(seq, zero, step).alias("s")).select(key, "s.generation", F.col("s.until").isNotNull().alias("leased"), "s.used")


def running_count(events: DataFrame, key: str, order: list[str], hit: Column, most: int) -> DataFrame:
    """For each key, how many hits, and the first event (by order) at which they reach `most`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumn("_n", F.sum(hit.cast("int")).over(w))
    return out.groupBy(key).agg(F.max("_n").alias("hits"), F.min(F.when(F.col("_n") >= most, F.struct(*order))).alias("first"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions of each key: events with less than the gap between them."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def valid_key(events: DataFrame, keys: DataFrame, on: str, ts: str) -> DataFrame:
    """Events with the key whose half-open interval [not_before, not_after) has them (equi join and range)."""
    j = events.join(keys, (events[on] == keys["key_owner"]) & (F.col(ts) >= F.col("not_before")) & (F.col(ts) < F.col("not_after")), "left")
    return j.drop("key_owner")


def first_free(reserved: DataFrame, key: str, slot: str, slots: int) -> DataFrame:
    """The smallest of 1..slots that isn't reserved, null if all are."""
    free = F.array_except(F.sequence(F.lit(1), F.lit(slots)), F.col("_taken"))
    return reserved.groupBy(key).agg(F.collect_set(slot).alias("_taken")).select(key, F.array_min(free).alias("free"))
