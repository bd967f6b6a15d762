"""Evidence matrices, ordered chains, constraints, package graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut


def pair_minima(rows: DataFrame, levels: list[list[str]], score: str, digits: int = 6, pairs: str | None = None) -> DataFrame:
    """Least score, and the number of pairs, at each level (a list of columns; [] is the whole). A row is
    a pair, or as many as its column `pairs` says."""
    every = list(dict.fromkeys(c for level in levels for c in level))
    g = rows.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in every])
    return g.agg(F.round(F.min(score), digits).alias("minimum"), (F.sum(pairs) if pairs else F.count(F.lit(1))).alias("pairs"), F.grouping_id().alias("level"))


#: Vectors in a block, two of which meet in one task.
BLOCK = 1024


def cosine_minima(vectors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, run_a, minimum, pairs: least cosine of each vector with those of larger keys in its group.

    A group's vectors are dealt into blocks by hash; two blocks meet in one group of rows, where one
    product of matrices has all their pairs. Nothing but a row for each vector leaves it, and a group of
    any size is as many groups of rows as it has pairs of blocks.
    """
    import numpy as np
    import pandas as pd

    v = vectors.select(F.col(group).alias("_g"), F.col(key).cast("long").alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    n = v.groupBy(F.col("_g").alias("_same")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    v = v.join(n, F.col("_g").eqNullSafe(F.col("_same"))).withColumn("_b", F.pmod(F.xxhash64("_k"), "_blocks"))
    v = v.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    v = v.select("_g", F.least("_b", "_other").alias("_i"), F.greatest("_b", "_other").alias("_j"), (F.col("_b") <= F.col("_other")).alias("_first"), "_k", "_v")

    def least(x: pd.DataFrame) -> pd.DataFrame:
        keys, m = x["_k"].to_numpy(), np.stack(x["_v"].to_list())
        m = m / np.sqrt((m * m).sum(1, keepdims=True))
        one = x["_first"].to_numpy()
        two = one if x["_i"].iloc[0] == x["_j"].iloc[0] else ~one
        score, before = m[one] @ m[two].T, keys[one][:, None] < keys[two][None, :]
        sides = [(keys[one], np.where(before, score, np.inf).min(1, initial=np.inf), before.sum(1))]
        if two is not one:
            after = keys[one][:, None] > keys[two][None, :]
            sides.append((keys[two], np.where(after, score, np.inf).min(0, initial=np.inf), after.sum(0)))
        k, s, c = (np.concatenate(a) for a in zip(*sides, strict=True))
        return pd.DataFrame({"_g": [x["_g"].iloc[0]] * (c > 0).sum(), "_k": k[c > 0], "_s": s[c > 0], "_n": c[c > 0]})

    found = v.groupBy("_g", "_i", "_j").applyInPandas(least, f"_g {vectors.schema[group].dataType.simpleString()}, _k long, _s double, _n long")
    return found.groupBy(F.col("_g").alias(group), F.col("_k").alias("run_a")).agg(F.min("_s").alias("minimum"), F.sum("_n").alias("pairs"))


def chain_breaks(rows: DataFrame, chain: list[str], sequence: str, digest: Column, previous: str) -> DataFrame:
    """Adds gap (sequence isn't the one before + 1) and broken (previous isn't the digest before)."""
    w = Window.partitionBy(*chain).orderBy(sequence)
    out = rows.withColumn("_digest", digest)
    gap = F.coalesce(F.col(sequence) != F.lag(sequence).over(w) + 1, F.lit(False))
    return out.withColumn("gap", gap).withColumn("broken", ~F.col(previous).eqNullSafe(F.lag("_digest").over(w))).drop("_digest")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reachable(spark, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that edges (source, target) lead to from roots (node): semi-naive closure.

    Each round joins only the nodes found last; the lineage is cut between rounds.
    """
    found = frontier = roots.select("node").distinct()
    while True:
        new = edges.join(frontier, F.col("source") == F.col("node"), "left_semi").select(F.col("target").alias("node")).distinct().join(found, "node", "left_anti")
        new = cut(new)
        if not new.take(1):
            return found
        found, frontier = cut(found.unionByName(new)), new


def content_type(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """Override by part name, else default by extension, else null (an error). Either table may be large:
    the planner broadcasts those it knows to be small."""
    ext = F.lower(F.regexp_extract("part_name", r"\.([^./]+)$", 1))
    j = parts.withColumn("extension", ext).join(overrides.withColumnRenamed("content_type", "_o"), "part_name", "left").join(defaults.withColumnRenamed("content_type", "_d"), "extension", "left")
    return j.withColumn("content_type", F.coalesce("_o", "_d")).drop("_o", "_d")


def ordered_digest(parts: DataFrame, keys: list[str], name: str, content: Column, domain: str) -> DataFrame:
    """sha256 over (length, name, length, content) in order of names, as framed text."""
    frame = F.concat(F.octet_length(F.col(name)).cast("string"), F.lit(":"), F.col(name), F.octet_length(content).cast("string"), F.lit(":"), content)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), frame.alias("v")))), lambda x: x["v"]), "")
    return parts.groupBy(*keys).agg(F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(domain), text), 256)).alias("digest"), F.count(F.lit(1)).alias("parts"))
