"""Release chains, key validity, accepted heads, sections of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order of the states of a release.
STATES = ("active", "frozen", "superseded")


def chain_problems(index: DataFrame) -> DataFrame:
    """index: chain, sequence, sha256, previous, state, issued_at, effective_at. The first problem of each row.

    Sequences run from 1 without gaps, previous is the hash before, times and states never go back.
    """
    w = Window.partitionBy("chain").orderBy("sequence")
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    i = index.withColumn("_n", F.row_number().over(w)).withColumn("_rank", rank)
    lag = lambda c: F.lag(c).over(w)
    problem = F.when(F.col("sequence") != F.col("_n"), "gap").when(~F.col("previous").eqNullSafe(lag("sha256")), "fork").when(F.col("issued_at") < lag("issued_at"), "issued earlier").when(F.col("effective_at") < F.col("issued_at"), "effective before issue").when(F.col("_rank") == 0, "unknown state").when(F.col("_rank") < lag("_rank"), "state goes back")
    return i.withColumn("problem", problem).drop("_n", "_rank")


def accepted_head(index: DataFrame, state: DataFrame) -> DataFrame:
    """state: chain, sequence, sha256 of the accepted head. The new head of each chain, or why not: rollback or fork."""
    head = index.groupBy("chain").agg(F.max(F.struct("sequence", "sha256")).alias("h"))
    at = index.select("chain", F.col("sequence").alias("_s"), F.col("sha256").alias("_there"))
    j = state.withColumnsRenamed({"sequence": "old", "sha256": "old_sha"}).join(head, "chain", "full_outer").join(at, ["chain"], "left").filter("old is null or _s = old or h is null or h.sequence < old")
    j = j.groupBy("chain", "old", "old_sha", "h").agg(F.max(F.when(F.col("_s") == F.col("old"), F.col("_there"))).alias("there"))
    return j.select("chain", F.col("h.sequence").alias("sequence"), F.when(F.col("h").isNull() | (F.col("h.sequence") < F.col("old")), "rollback").when(F.col("old").isNotNull() & ~F.col("there").eqNullSafe(F.col("old_sha")), "fork").otherwise("accepted").alias("verdict"))


def matrix_problems(pairs: DataFrame, recorded_pairs: DataFrame, recorded_pages: DataFrame, runs: int, pages: int, least: float) -> DataFrame:
    """pairs: run_a, run_b, page, ssim. Rows (check, found) of what doesn't hold: complete ordered
    pairs, recorded minima equal those recomputed, nothing below the least score."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    differ = ~F.col("m").eqNullSafe(F.col("r"))
    rows = pairs.agg(count(F.col("run_a") >= F.col("run_b")).alias("disordered pairs"), count(F.col("ssim") < least).alias("below threshold"))
    by_pair = pairs.groupBy("run_a", "run_b").agg(F.min("ssim").alias("m"), F.count(F.lit(1)).alias("n"))
    by_pair = by_pair.join(recorded_pairs.withColumnRenamed("minimum_ssim", "r"), ["run_a", "run_b"], "full_outer")
    by_pair = by_pair.agg((runs * (runs - 1) // 2 - F.count("n")).alias("missing pairs"), count(F.col("n") != pages).alias("incomplete pairs"), count(differ).alias("pair minima differ"))
    by_page = pairs.groupBy("page").agg(F.min("ssim").alias("m")).join(recorded_pages.withColumnRenamed("minimum_ssim", "r"), ["page"], "full_outer")
    by_page = by_page.agg(count(differ).alias("page minima differ"))
    every = rows.crossJoin(by_pair).crossJoin(by_page)  # one row each
    found = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("found")) for c in every.columns)))
    return every.select(found.alias("x")).select("x.*").filter("found <> 0")


def constraint(df: DataFrame, name: str, broken, key) -> DataFrame:
    """Rows of a violations table: constraint, subject; union those of several constraints."""
    return df.filter(F.coalesce(broken, F.lit(False))).select(F.lit(name).alias("constraint"), key.cast("string").alias("subject"))
