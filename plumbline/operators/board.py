"""Campaign statistics, robustness and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut

REQUIRED_RUNS = 3


def first_runs(runs: DataFrame, campaign: list[str], order: list[str], most: int = REQUIRED_RUNS) -> DataFrame:
    """The first runs of every campaign with their slot (1 to most); Spark limits groups before the shuffle."""
    w = Window.partitionBy(*campaign).orderBy(*order)
    return runs.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= most)


def campaign_stats(runs: DataFrame, campaign: list[str], score: str, eligible: Column) -> DataFrame:
    """mean, official only with exactly three runs and else provisional; best, worst, population
    deviation, count; record over eligible runs. A null score counts as 0.0."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    g = runs.groupBy(*campaign).agg(F.round(F.avg(s), 6).alias("mean"), F.max(s).alias("best"), F.min(s).alias("worst"), F.round(F.stddev_pop(s), 6).alias("deviation"), F.count(F.lit(1)).alias("runs"), F.max(F.when(eligible, F.col(score))).alias("record"))
    done = F.col("runs") == REQUIRED_RUNS
    return g.withColumn("official_mean", F.when(done, F.col("mean"))).withColumn("provisional_mean", F.when(~done, F.col("mean"))).drop("mean")


def robustness(campaigns: DataFrame, group: list[str], variant: str, required: tuple[str, ...]) -> DataFrame:
    """Least official mean over the variants, with mean and deviation of the means; null unless
    the variants with official means are just the required ones."""
    done = campaigns.filter("official_mean is not null")
    every = F.array_sort(F.collect_set(variant)) == F.array(*(F.lit(v) for v in sorted(required)))
    g = done.groupBy(*group).agg(every.alias("all"), F.min("official_mean").alias("m"), F.round(F.avg("official_mean"), 6).alias("a"), F.round(F.stddev_pop("official_mean"), 6).alias("d"))
    out = campaigns.select(*group).distinct().join(g, group, "left")
    return out.select(*group, F.when(F.col("all"), F.col("m")).alias("robustness"), F.when(F.col("all"), F.col("a")).alias("variant_mean"), F.when(F.col("all"), F.col("d")).alias("variant_deviation"))


def rank(entries: DataFrame, board: list[str], order: list[Column]) -> DataFrame:
    """position in each board; the order must end with a unique key.

    Entries are dealt by ranges of the order, so that a board is not one task: a position is the place in
    the range after the numbers of the ranges before.
    """
    dealt = cut(entries.repartitionByRange(*board, *order).withColumn("_part", F.spark_partition_id()))
    ranges = dealt.groupBy(*board, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = ranges.withColumn("_before", F.sum("_n").over(Window.partitionBy(*board).orderBy("_part")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*board, "_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(before), [*board, "_part"]).withColumn("position", (F.col("_place") + F.col("_before")).cast("int")).select(*entries.columns, "position")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and the total number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
