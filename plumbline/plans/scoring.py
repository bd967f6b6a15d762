"""Score queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.score import fidelity
from plumbline.sources import load


def fidelity_score(spark, sf_dir):
    """Deck = supplier, rule item = lineitem, severity by the part's size class, pass = not returned."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("critical", "major", "minor", "informational"))), (F.col("p_size") % 4 + 1).cast("int")).alias("severity"))
    items = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") != "R").alias("passed"))
    return fidelity(items.join(part, F.col("l_partkey") == F.col("p_partkey")), ["l_suppkey"])


FIDELITY = """
select l_suppkey, coalesce(round(sum(case when l_returnflag <> 'R' then w else 0 end) / nullif(sum(w), 0), 4), 0.0) as fidelity,
  count(*) filter (where l_returnflag <> 'R' and w > 0) as passed_items, count(*) filter (where w > 0) as total_items
from lineitem join (select p_partkey, 3 - p_size % 4 as w from part) on l_partkey = p_partkey group by l_suppkey"""

QUERIES = {"fidelity_score": (fidelity_score, FIDELITY)}
