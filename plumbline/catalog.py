"""Registry of the conformance queries: name -> (DataFrame builder, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import boards, diffs, evidence, grading, integrity, projections, rules, scoring, services, texts

MODULES = (scoring, grading, projections, rules, diffs, boards, evidence, integrity, texts, services)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
