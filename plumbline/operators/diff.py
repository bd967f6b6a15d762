"""Structural and positional differences of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows that differ: keys, change_type (missing, unexpected, changed), changed_fields.

    One full outer join; values are compared null-safely.
    """
    a = left.select(*keys, F.struct(*fields).alias("_a"))
    b = right.select(*keys, F.struct(*fields).alias("_b"))
    j = a.join(b, keys, "full_outer")
    names = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields))), ",")
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(names != "", "changed")
    return j.withColumn("change_type", kind).filter("change_type is not null").select(*keys, "change_type", F.when(F.col("change_type") == "changed", names).otherwise("").alias("changed_fields"))


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of either side without the other: keys, side.

    Keys shrink much in a shuffle, and partitions merged by their size there would hold very many in
    memory; so their number is set, by the session.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (df.select(*on).repartition(parts, *on).distinct() for df in (left, right))  # noqa: E741
    return l.join(r, on, "left_anti").withColumn("side", F.lit("missing")).unionByName(r.join(l, on, "left_anti").withColumn("side", F.lit("unexpected")))


def subset(df: DataFrame, keys: list[str], value: str, required: tuple[str, ...]) -> DataFrame:
    """Whether each key has all required values, those it lacks, and whether it has no others."""
    have = F.array_sort(F.collect_set(F.col(value)))
    need = F.array(*(F.lit(v) for v in sorted(required)))
    out = df.groupBy(*keys).agg(have.alias("_have"))
    lack = F.array_except(need, F.col("_have"))
    return out.select(*keys, F.array_join(lack, ",").alias("lacking"), (F.size(lack) == 0).alias("complete"), F.col("_have").eqNullSafe(need).alias("equal"))


def excerpt(text: Column, most: int = 42, keep: int = 39) -> Column:
    """At most `most` characters; longer texts are cut to `keep`, stripped at the end, with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, keep)), F.lit("…"))).otherwise(text)


def label(kind: Column, text: Column, name: Column, path: Column) -> Column:
    """An object's label: its type with the excerpt of its text, else its name, else its path."""
    text = F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))
    return F.concat(kind, F.lit(" "), F.coalesce(excerpt(text), F.nullif(name, F.lit("")), path))
