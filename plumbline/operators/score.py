"""Severity-weighted scores of rule results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each severity; any other severity weighs 0.
WEIGHTS = {"critical": 3, "major": 2, "minor": 1, "informational": 0}


def weight(severity: Column) -> Column:
    """Severity to integer weight; unknown or null severities weigh 0."""
    out = F.lit(0)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, F.lit(w)).otherwise(out)
    return out


def fidelity(results: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """sum(weight of passed) / sum(weight) for each key, 0.0 without weight.

    results: keys..., severity, passed. Informational rows count nowhere; a key with no others has 0.0.
    Integer sums keep the ratio independent of row order.
    """
    scored = results.withColumn("_w", weight(F.col("severity"))).withColumn("_hit", F.coalesce(F.col("passed"), F.lit(False)) & (F.col("_w") > 0))
    return scored.groupBy(*keys).agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("_hit"), F.col("_w")).otherwise(0)), F.sum("_w")), F.lit(0.0)), digits).alias("fidelity"),
        F.count_if("_hit").alias("passed_items"),
        F.count_if(F.col("_w") > 0).alias("total_items"),
    )
