"""Projections of nested documents: freezes, reviews without approvals, assertions, seeded noise."""

from __future__ import annotations

import hashlib
import json
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrow import jcs

#: What property an assertion is about, by the kind of its rule.
PROPERTY = {
    "structure": "native_structure", "typography": "visual_typography", "image-asset": "asset_identity", "fields": "field", "theme-consistency": "theme", "multilingual": "text_content", "visual": "visual_appearance", "spacing-autofit": "visual_spacing",
    "gradient-pattern": "visual_color", "text": "text_content", "z-order": "native_structure", "grouping": "native_structure", "table": "table", "chart": "chart", "overflow": "editability",
}


def _named(name: str):
    return lambda r: r["name"] == name


def freeze(docs: DataFrame, document: str, paths: dict[str, str], only: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """A column for each path into a JSON document, and problem: the first that isn't a text with something
    in it. only: columns taken from the one record of a list with a given name: (list, name, field)."""
    found = {name: F.get_json_object(document, path) for name, path in paths.items()}
    records = "array<map<string,string>>"
    for name, (where, called, field) in (only or {}).items():
        met = F.filter(F.from_json(F.get_json_object(document, where), records), _named(called))
        found[name] = F.when(F.size(met) == 1, F.get(met, 0)[field])
    problem = F.lit(None).cast("string")
    for name, value in reversed(found.items()):
        problem = F.when(F.coalesce(value, F.lit("")) == "", name).otherwise(problem)
    return docs.withColumns(found | {"problem": problem})


def review_digest(document: Column, domain: str, member: str, left_out: str) -> Column:
    """SHA-256 of the canonical JSON of {domain, member: the document without left_out}; null for what is no object."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                found = json.loads(text)
            except (TypeError, ValueError):
                return None
            if not isinstance(found, dict):
                return None
            kept = {k: v for k, v in found.items() if k != left_out}
            return "sha256:" + hashlib.sha256(jcs({"domain": domain, member: kept}).encode()).hexdigest()

        return texts.map(one)

    return digest(document)


def assertions(rules: DataFrame) -> DataFrame:
    """rules: id, kind, method, selector, expectation (map of texts). assertion_id, property_class,
    verification_method and expected (with the selector, or the rule's id where nothing else is expected)."""
    prefix, suffix = F.substring_index("id", ".", 1), F.expr("substr(id, instr(id, '.') + 1)")
    classes = F.create_map(*(F.lit(x) for pair in PROPERTY.items() for x in pair))
    layout = F.when(F.col("id").contains("master"), "master").otherwise("layout")
    none = F.create_map().cast("map<string,string>")
    chosen = F.when(F.coalesce("selector", F.lit("")) != "", F.create_map(F.lit("selector"), "selector")).otherwise(none)
    expected = F.map_concat(F.map_filter(F.coalesce("expectation", none), lambda k, v: k != "selector"), chosen)
    return rules.withColumns({
        "assertion_id": F.when(F.instr("id", ".") > 0, F.concat(prefix, F.lit(".assert-"), suffix)).otherwise(F.concat(F.lit("deck.assert-"), "id")),
        "property_class": F.when(F.col("kind") == "master-layout", layout).otherwise(classes[F.col("kind")]),
        "verification_method": F.when(F.col("method") == "hash_match", "embedded_media_hash").otherwise(F.col("method")),
        "expected": F.when(F.size(expected) == 0, F.create_map(F.lit("rule"), "id")).otherwise(expected),
    })


def jitter(seed: Column, width: float, bias: float = 0.0) -> Column:
    """bias plus the first uniform number of Python's Mersenne Twister with this seed, within +-width."""

    @F.pandas_udf("double")
    def draw(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: None if pd.isna(s) else random.Random(int(s)).uniform(-width, width) + bias)

    return draw(seed.cast("long"))
