"""Rule evaluation: a rule is (method, selector, expectation) and yields passed and detail.

Nodes are aggregated once per deck (one count per distinct selector), however many rules there
are; rules are literal data that is exploded over the aggregate, so that nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(*cases: tuple[Column, Column | str], ok: str = "ok") -> tuple[Column, Column]:
    """(passed, detail): the first true condition names the failure; null conditions don't hold."""
    detail = F.lit(ok)
    failed = F.lit(False)
    for cond, text in reversed(cases):
        cond = F.coalesce(cond, F.lit(False))
        detail = F.when(cond, F.lit(text) if isinstance(text, str) else text).otherwise(detail)
        failed = failed | cond
    return ~failed, detail


def selector_counts(nodes: DataFrame, keys: list[str], selectors: dict[str, Column]) -> DataFrame:
    """keys and n_<selector> for each selector: rule fusion in one aggregate."""
    return nodes.groupBy(*keys).agg(*(F.count_if(c).alias(f"n_{name}") for name, c in selectors.items()))


def object_compare(decks: DataFrame, rules: list[dict]) -> DataFrame:
    """Count rules: required and none, then exact_count, then min_count (0). decks: n_<selector> columns.

    A deck without nodes (null counts) fails every rule as not found.
    """
    rows = [F.struct(F.lit(r["id"]).alias("rule_id"), F.col(f"n_{r['selector']}").alias("n"), F.lit(r.get("required", False)).alias("required"), F.lit(r.get("exact_count")).cast("int").alias("exact"), F.lit(r.get("min_count", 0)).alias("least")) for r in rules]
    keys = [c for c in decks.columns if not c.startswith("n_")]
    r = decks.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    n = F.col("n")
    passed, detail = first_failure(
        (n.isNull(), "slide not found"), (F.col("required") & (n == 0), "required but missing"),
        (n != F.col("exact"), F.concat(F.lit("expected "), F.col("exact").cast("string"), F.lit(", found "), n.cast("string"))),
        (n < F.col("least"), F.concat(F.lit("at least "), F.col("least").cast("string"), F.lit(", found "), n.cast("string"))),
    )
    return r.select(*keys, "rule_id", F.coalesce(n, F.lit(0)).alias("observed"), passed.alias("passed"), detail.alias("detail"))


def text_match(df: DataFrame, text: str, contains: str = "", exact: str = "", not_contains: str = "") -> DataFrame:
    """Adds passed and detail. An empty expectation isn't checked."""
    t = F.coalesce(F.col(text), F.lit(""))
    cases = []
    if contains:
        cases.append((~t.contains(contains), "missing text"))
    if exact:
        cases.append((F.regexp_replace(t, r"(?U)^\s+|\s+$", "") != exact, "text differs"))
    if not_contains:
        cases.append((t.contains(not_contains), "forbidden text"))
    passed, detail = first_failure(*cases)
    return df.withColumns({"passed": passed, "detail": detail})


def allow_list(df: DataFrame, keys: list[str], value: str, allowed: tuple[str, ...]) -> DataFrame:
    """Distinct values outside the allow-list (case-insensitive; empty and '+...' are ignored)."""
    v = F.col(value)
    bad = F.when((v != "") & ~v.startswith("+") & ~F.lower(v).isin(*allowed), v)
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(bad)), ",").alias("violations"), (F.count(bad) == 0).alias("passed"))


def area_ratio(nodes: DataFrame, keys: list[str], order: list[str], area: Column, page: float, most: float = 0.4) -> DataFrame:
    """First node by order whose share of the page is above `most` (strictly)."""
    ratio = area / F.lit(page)
    hit = F.min(F.when((area > 0) & (ratio > most), F.struct(*order, ratio.alias("ratio"))))
    return nodes.groupBy(*keys).agg(hit.alias("h")).select(*keys, F.col("h").isNull().alias("passed"), *(F.col(f"h.{c}").alias(f"first_{c}") for c in order), F.floor(F.col("h.ratio") * 100).cast("long").alias("percent"))


def similarity_floor(df: DataFrame, keys: list[str], score: str, floor: float) -> DataFrame:
    """All scores at or above the floor, with their number, least and mean; null scores fail."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count_if(s >= floor).alias("n_ok"), F.count(F.lit(1)).alias("n"), F.round(F.min(s), 6).alias("min_score"), F.round(F.avg(s), 6).alias("mean_score"), F.bool_and(s >= floor).alias("passed"))


def zeroed(results: DataFrame, keys: list[str]) -> DataFrame:
    """Failure propagation in two passes over (keys, item, passed, zeroes, is_deck).

    A failed item that zeroes takes the passed slide items of its key with it; deck items stay.
    The set of zeroed keys comes from the raw results.
    """
    hit = results.filter(~F.col("passed") & F.col("zeroes")).select(*keys).distinct().withColumn("_hit", F.lit(True))
    out = results.join(hit, keys, "left")
    taken = F.coalesce("_hit", F.lit(False)) & ~F.col("is_deck") & F.col("passed")
    outcome = F.when(taken, "zeroed_by_anti_cheat").when(F.col("passed"), "passed").otherwise("failed")
    return out.withColumn("outcome", outcome).withColumn("passed", F.col("passed") & ~taken).drop("_hit")


def mismatched(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Names of the fields whose values differ, null-safely, sorted and comma-joined."""
    names = [F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in sorted(pairs, key=lambda p: p[0])]
    return F.array_join(F.array_compact(F.array(*names)), ",")
