"""Connected components of a link table by alternating large and small stars.

(Kiveris and others, 2014.) Every round is a few joins and aggregates over the links, written to
the checkpoint folder; nothing but two numbers per round comes to the driver. Links of a node
with very many neighbours are aggregated before they are sent, and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every node that isn't a root; root is the smallest node reached."""
    edges = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large.filter("u > v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = checkpoint(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
