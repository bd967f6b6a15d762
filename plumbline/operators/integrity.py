"""Constraint queries: each yields rows (broken_rule, subject) that break it; union them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def where(df: DataFrame, name: str, broken: Column, subject: Column) -> DataFrame:
    """Rows for which the condition holds; unknown counts as not broken."""
    return df.filter(F.coalesce(broken, F.lit(False))).select(F.lit(name).alias("broken_rule"), subject.cast("string").alias("subject"))


def unique(df: DataFrame, name: str, *keys: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return g.select(F.lit(name).alias("broken_rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("subject"))


def exact_count(df: DataFrame, name: str, keys: list[str], want: int) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") != want)
    return g.select(F.lit(name).alias("broken_rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("subject"))


def thresholds(rules: DataFrame, want: float, name: str = "ssim threshold") -> DataFrame:
    """Visual rules (id, method, min_ssim) whose threshold isn't the one all must have."""
    return where(rules.filter("method = 'visual_ssim'"), name, ~F.col("min_ssim").eqNullSafe(F.lit(want)), F.col("id"))


def members(df: DataFrame, name: str, key: str, member: str, want: list | None = None) -> DataFrame:
    """Keys whose members aren't just the wanted ones, each once or more; without any wanted, the whole
    numbers from 1 to as many as the key has rows (a prefix, each once)."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    right = F.array(*(F.lit(x) for x in sorted(want))) if want is not None else F.sequence(F.lit(1).cast("long"), "_n")
    have = F.col("_m") if want is not None else F.transform("_m", lambda x: x.cast("long"))
    return where(g, name, have != right, F.col(key))


def recorded_means(df: DataFrame, name: str, key: str, value: str, recorded: DataFrame, digits: int = 4) -> DataFrame:
    """Keys whose mean over the rows isn't what recorded (key, mean) says, or that one side lacks."""
    g = df.groupBy(key).agg(F.round(F.avg(value), digits).alias("_mean"))
    return same_values(g.select(key, F.col("_mean").alias("mean")), recorded.select(key, "mean"), name, key, "mean")


def pairwise(df: DataFrame, name: str, group: str, item: str, want: int) -> DataFrame:
    """Groups that don't have `want` different items, hence not all their want (want - 1) / 2 pairs."""
    g = df.groupBy(group).agg(F.count_distinct(item).alias("_n"))
    return where(g, name, F.col("_n") != want, F.col(group))


def references(df: DataFrame, name: str, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Keys that the target lacks; nulls refer to nothing."""
    t = target.select(F.col(target_key).alias("_t")).distinct()
    d = df.select(key).filter(F.col(key).isNotNull()).distinct().join(t, F.col(key) == F.col("_t"), "left_anti")
    return d.select(F.lit(name).alias("broken_rule"), F.col(key).cast("string").alias("subject"))


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows of either side, counted, that the other lacks (a projection check)."""
    text = F.to_json(F.struct(*a.columns))
    left, right = a.exceptAll(b.select(*a.columns)), b.select(*a.columns).exceptAll(a)
    return left.unionByName(right).select(F.lit(name).alias("broken_rule"), text.alias("subject"))


def same_values(a: DataFrame, b: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two key-value tables (facts against a frozen profile)."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    return where(j, name, ~F.col("_a").eqNullSafe(F.col("_b")), F.col(key))


def region(x: Column, y: Column, w: Column, h: Column, width: int = 1920, height: int = 1080) -> Column:
    """Whether a region lies within the page."""
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)


def recorded_excerpts(requirements: DataFrame, sources: DataFrame) -> DataFrame:
    """requirements: requirement_id, source_id, line_start, line_end, excerpt_sha256; sources:
    source_id, text. Requirements whose lines don't hash to what they recorded (or have no source)."""
    lines = sources.select("source_id", F.posexplode(F.split("text", "\n")).alias("_l", "_t"))
    j = requirements.join(lines, (requirements["source_id"] == lines["source_id"]) & (F.col("_l") + 1 >= F.col("line_start")) & (F.col("_l") + 1 <= F.col("line_end")), "left")
    g = j.groupBy("requirement_id", "excerpt_sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_l", "_t"))), lambda x: x["_t"]), "\n").alias("_e"))
    return where(g, "excerpt", F.sha2("_e", 256) != F.col("excerpt_sha256"), F.col("requirement_id"))


def scene_numbering(nodes: DataFrame) -> DataFrame:
    """Node ids, z-indexes and parents recomputed from the paths of flattened scene graphs."""
    dotted = F.array_join(F.transform("path", lambda x: x.cast("string")), ".")
    me = F.concat(F.lit("s"), F.col("slide").cast("string"), F.lit(":n"), dotted)
    kids = nodes.groupBy("package_id", "slide", "parent_path").agg(F.array_sort(F.collect_list("z_index")).alias("z"), F.count(F.lit(1)).alias("n"))
    parent = nodes.select("package_id", "slide", F.col("path").alias("parent_path"), F.lit(True).alias("_there"))
    lone = nodes.filter("depth > 1").join(parent, ["package_id", "slide", "parent_path"], "left")
    return violations(
        where(nodes, "node id", F.col("node_id") != me, F.col("node_id")),
        where(kids, "z-index", F.col("z") != F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.concat_ws(":", "package_id", F.col("slide").cast("string"))),
        where(lone, "parent", F.col("_there").isNull(), F.col("node_id")),
        unique(nodes, "unique node", "package_id", "node_id"),
    )
