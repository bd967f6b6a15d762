"""Campaign and leaderboard queries: customer = campaign, order = run, nation = organization."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import board as B
from plumbline.sources import load

NOW = "2001-09-02 00:00:00"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def runs(spark, sf):
    return load(spark, sf, "orders").filter("o_orderstatus = 'F'")


def slots(spark, sf):
    return B.first_runs(runs(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"])


SLOTS = "(select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as slot from orders where o_orderstatus = 'F' qualify slot <= 3)"


def campaign_slots(spark, sf):
    """The first three completed runs of every campaign."""
    return slots(spark, sf).select("o_custkey", "slot", "o_orderkey")


CAMPAIGN_SLOTS = f"select o_custkey, slot, o_orderkey from {SLOTS}"


def stats(spark, sf):
    return B.campaign_stats(slots(spark, sf).withColumn("score", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice"))), ["o_custkey"], "score", ~F.col("o_orderpriority").startswith("5"))


STATS = f"""(select o_custkey, max(s) as best, min(s) as worst, round(stddev_pop(s), 6) as deviation, count(*) as runs, max(x) filter (where not starts_with(o_orderpriority, '5')) as record,
 case when count(*) = 3 then round(avg(s), 6) end as official_mean, case when count(*) <> 3 then round(avg(s), 6) end as provisional_mean
 from (select *, case when o_orderkey % 17 <> 0 then o_totalprice end as x, coalesce(x, 0) as s from {SLOTS}) group by o_custkey)"""


def campaign_stats(spark, sf):
    """Mean, best, worst, deviation and record of every campaign."""
    return stats(spark, sf)


def robustness_score(spark, sf):
    """Least of the variants' means: a group is a nation and a decade of customers, a variant is a segment."""
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    r = B.first_runs(runs(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey")), ["c_nationkey", "c_mktsegment"], ["o_orderdate", "o_orderkey"])
    r = r.filter("not (c_nationkey % 4 = 1 and c_mktsegment = 'BUILDING' and slot = 3)")
    s = B.campaign_stats(r, ["c_nationkey", "c_mktsegment"], "o_totalprice", F.lit(True))
    return B.robustness(s, ["c_nationkey"], "c_mktsegment", SEGMENTS)


ROBUSTNESS = """
with r as (select c_nationkey, c_mktsegment, o_totalprice, row_number() over (partition by c_nationkey, c_mktsegment order by o_orderdate, o_orderkey) as slot
 from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' qualify slot <= 3),
m as (select c_nationkey, c_mktsegment, case when count(*) = 3 then round(avg(o_totalprice), 6) end as m from r where not (c_nationkey % 4 = 1 and c_mktsegment = 'BUILDING' and slot = 3) group by all)
select c_nationkey, case when count(m) = 5 then min(m) end as robustness, case when count(m) = 5 then round(avg(m), 6) end as variant_mean, case when count(m) = 5 then round(stddev_pop(m), 6) end as variant_deviation
from m group by c_nationkey"""


def campaign_status(spark, sf):
    """completed, closed incomplete, provisional or open, by runs and the closing time (7 days after
    the first order); the mean only of completed ones."""
    o = load(spark, sf, "orders").groupBy("o_custkey").agg((F.min("o_orderdate") + F.expr("interval 900 days")).alias("closes"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    late = F.col("closes") < F.lit(NOW).cast("timestamp")
    status = F.when(F.col("done") >= 3, "completed").when(late & (F.col("done") > 0), "closed_incomplete").when(F.col("done") > 0, "provisional").otherwise("open")
    return o.join(stats(spark, sf).select("o_custkey", "official_mean"), "o_custkey", "left").select("o_custkey", status.alias("status"), F.when(status == "completed", F.col("official_mean")).alias("mean"))


CAMPAIGN_STATUS = f"""
with o as (select o_custkey, min(o_orderdate) + interval 900 day as closes, count(*) filter (where o_orderstatus = 'F') as done from orders group by 1)
select o.o_custkey, case when done >= 3 then 'completed' when closes < timestamp '{NOW}' and done > 0 then 'closed_incomplete' when done > 0 then 'provisional' else 'open' end as status,
 case when done >= 3 then official_mean end as mean from o left join {STATS} s using (o_custkey)"""


def leaderboard(spark, sf):
    """Two boards (standard, assisted), ranked campaigns first, then by mean, closing time and id."""
    last = runs(spark, sf).groupBy("o_custkey").agg(F.max("o_orderdate").alias("closes"))
    c = load(spark, sf, "customer").select("c_custkey", (F.col("c_mktsegment") == "MACHINERY").alias("assisted"))
    e = stats(spark, sf).join(last, "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("ranked", F.col("official_mean").isNotNull())
    order = [F.desc("ranked"), F.coalesce("official_mean", F.lit(-1.0)).desc(), F.desc("closes"), F.asc("o_custkey")]
    return B.rank(e, ["assisted"], order).select("assisted", "position", "o_custkey", "official_mean", "ranked")


LEADERBOARD = f"""
with l as (select o_custkey, max(o_orderdate) as closes from orders where o_orderstatus = 'F' group by 1)
select assisted, row_number() over (partition by assisted order by ranked desc, coalesce(official_mean, -1) desc, closes desc, o_custkey)::int as position, o_custkey, official_mean, ranked
from (select s.*, closes, c_mktsegment = 'MACHINERY' as assisted, official_mean is not null as ranked from {STATS} s join l using (o_custkey) join customer on o_custkey = c_custkey)"""


def run_ledger_page(spark, sf):
    """Rows 100 to 149 of the completed runs, newest first, with the total."""
    return B.page(runs(spark, sf).select("o_orderkey", F.unix_timestamp("o_orderdate").alias("completed")), [F.desc("completed"), F.desc("o_orderkey")], 100, 50)


RUN_LEDGER = """
select o_orderkey, epoch(o_orderdate)::bigint as completed, (select count(*) from orders where o_orderstatus = 'F') as total
from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 50 offset 100"""


def latest_per_key(spark, sf):
    """Latest completed run of each customer and priority."""
    return B.latest(runs(spark, sf), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


LATEST = """
select o_custkey, o_orderpriority, o_orderkey from orders where o_orderstatus = 'F'
qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey) = 1"""


def stale_campaigns(spark, sf):
    """Campaigns whose newest completion is over 30 days old (the fallback is now)."""
    now = F.lit(NOW).cast("timestamp")
    g = load(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))), now).alias("newest"))
    return g.select("o_custkey", (F.col("newest") < now - F.expr("interval 30 days")).alias("stale"), F.expr(f"timestampdiff(DAY, newest, timestamp '{NOW}')").alias("age_days"))


STALE = f"""
with g as (select o_custkey, coalesce(max(o_orderdate) filter (where o_orderstatus = 'F'), timestamp '{NOW}') as newest from orders group by 1)
select o_custkey, newest < timestamp '{NOW}' - interval 30 day as stale, date_sub('day', newest, timestamp '{NOW}') as age_days from g"""


def run_metrics(spark, sf):
    """Weighted percent over the native items: those whose part isn't a visual one."""
    visual = load(spark, sf, "part").filter("p_size % 5 = 0").select(F.col("p_partkey").alias("l_partkey"))
    n = load(spark, sf, "lineitem").join(visual, "l_partkey", "left_anti").withColumn("w", 3 - F.col("l_partkey") % 4).filter("w > 0")
    return n.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") != "R", F.col("w")).otherwise(0)).alias("passed_weight"), F.sum("w").alias("weight")).withColumn("percent", F.round(F.col("passed_weight") * 100 / F.col("weight"), 2))


RUN_METRICS = """
select l_orderkey, sum(case when l_returnflag <> 'R' then w else 0 end)::bigint as passed_weight, sum(w)::bigint as weight, round(sum(case when l_returnflag <> 'R' then w else 0 end) * 100 / sum(w), 2) as percent
from (select *, 3 - l_partkey % 4 as w from lineitem where l_partkey not in (select p_partkey from part where p_size % 5 = 0)) where w > 0 group by 1"""


def path_means(spark, sf):
    """Mean of the runs' rounded percents for each priority."""
    m = run_metrics(spark, sf).join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cents = F.round(F.col("percent") * 100).cast("long")
    return m.groupBy("o_orderpriority").agg(F.round(F.sum(cents) / 100 / F.count(F.lit(1)), 2).alias("mean_percent"), F.count(F.lit(1)).alias("runs"))


PATH_MEANS = f"""
select o_orderpriority, round(sum(round(percent * 100)::bigint) / 100 / count(*), 2) as mean_percent, count(*) as runs from ({RUN_METRICS}) join orders on l_orderkey = o_orderkey group by 1"""


def totals_distinct(spark, sf):
    """Runs, sorted distinct seeds (line numbers), slides, and how many parts occur more than once."""
    l = load(spark, sf, "lineitem")  # noqa: E741
    dup = l.groupBy("l_suppkey", "l_partkey").count().groupBy("l_suppkey").agg(F.count_if(F.col("count") > 1).alias("duplicates"))
    g = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("runs"), F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("seeds"), (F.count(F.lit(1)) * 20).alias("slides"))
    return g.join(dup, "l_suppkey")


TOTALS = """
select l_suppkey, count(*) as runs, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) as seeds, count(*) * 20 as slides, any_value(duplicates) as duplicates
from lineitem join (select l_suppkey, count(*) filter (where n > 1) as duplicates from (select l_suppkey, l_partkey, count(*) as n from lineitem group by all) group by 1) using (l_suppkey) group by 1"""

QUERIES = {
    "campaign_slots": (campaign_slots, CAMPAIGN_SLOTS),
    "campaign_stats": (campaign_stats, f"select * from {STATS}"),
    "robustness_score": (robustness_score, ROBUSTNESS),
    "campaign_status": (campaign_status, CAMPAIGN_STATUS),
    "leaderboard": (leaderboard, LEADERBOARD),
    "run_ledger_page": (run_ledger_page, RUN_LEDGER),
    "latest_per_key": (latest_per_key, LATEST),
    "stale_campaigns": (stale_campaigns, STALE),
    "run_metrics": (run_metrics, RUN_METRICS),
    "path_means": (path_means, PATH_MEANS),
    "totals_distinct": (totals_distinct, TOTALS),
}
