"""Affected slides: named selectors with a content hash, configured lists, or the current slide."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrow import jcs
from plumbline.operators.checklist import FONTS, failures

Selector = Callable[[dict[str, DataFrame]], DataFrame]


def descriptor_hash(descriptor: dict) -> str:
    return f"sha256:{hashlib.sha256(jcs(descriptor).encode()).hexdigest()}"


class Registry:
    """Selectors by id. One is usable only under the hash of its descriptor that it was registered with."""

    def __init__(self):
        self._known: dict[str, tuple[str, Selector]] = {}

    def register(self, descriptor: dict, build: Selector, sha256: str | None = None) -> str:
        """descriptor needs selector_id; a given hash must be the descriptor's."""
        found = descriptor_hash(descriptor)
        if sha256 is not None and sha256 != found:
            raise ValueError(f"{descriptor['selector_id']}: descriptor hash differs")
        self._known[descriptor["selector_id"]] = (found, build)
        return found

    def known(self) -> dict[str, tuple[str, Selector]]:
        """Hash and selector by id."""
        return dict(self._known)

    def hashes(self) -> Column:
        """A map of the hashes by id."""
        known = [F.lit(x) for i, (sha, _) in self._known.items() for x in (i, sha)]
        return F.create_map(*known) if known else F.create_map().cast("map<string,string>")

    def slides(self, tables: dict[str, DataFrame], selector_id: str, sha256: str) -> DataFrame:
        """deck_id, slide. Unknown ids and other hashes are errors."""
        found, build = self._known.get(selector_id, (None, None))
        if found is None or found != sha256:
            raise ValueError(f"{selector_id}: unknown selector or other hash")
        return build(tables).select("deck_id", "slide").distinct()


def notes_or_comments(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["notes"].filter(F.col("notes") | F.col("comments"))


def unlisted_fonts(tables: dict[str, DataFrame]) -> DataFrame:
    f = tables["nodes"].select("deck_id", "slide", F.explode("runs.font").alias("font"))
    return f.filter((F.col("font") != "") & ~F.col("font").startswith("+") & ~F.lower("font").isin(*FONTS))


def default_registry() -> Registry:
    """The two selectors that automatic failures of a deck use."""
    known = Registry()
    known.register({"selector_id": "non-bundled-font", "version": 1}, unlisted_fonts)
    known.register({"selector_id": "notes-comments", "version": 1}, notes_or_comments)
    return known


def chosen(tables: dict[str, DataFrame], registry: Registry) -> DataFrame:
    """deck_id, slide, selector_id: what all selectors of the registry name."""
    parts = [build(tables).select("deck_id", "slide").withColumn("selector_id", F.lit(i)) for i, (_, build) in registry.known().items()]
    return reduce(DataFrame.unionByName, parts, tables["slides"].select("deck_id", "slide").withColumn("selector_id", F.lit(None).cast("string")).limit(0))


def named_by_deck(tables: dict[str, DataFrame], registry: Registry) -> DataFrame:
    """deck_id, _named: selector_id and slides (sorted array) of each selector that names any of the deck."""
    g = chosen(tables, registry).repartition("deck_id").groupBy("deck_id", "selector_id").agg(F.array_sort(F.collect_set("slide")).alias("slides"))
    return g.groupBy("deck_id").agg(F.collect_list(F.struct("selector_id", "slides")).alias("_named"))


def named_slides(tables: dict[str, DataFrame], registry: Registry, failed: DataFrame) -> DataFrame:
    """deck_id, selector_id, selector_sha256, slides (sorted array): what all selectors of the registry
    name, one plan for any number of rules. A failure that names another selector or hash is an error."""
    known = registry.hashes()
    asked = failed.filter("affected_mode = 'named_selector'").select("deck_id", "selector_id", "selector_sha256").distinct()
    wrong = ~known[F.coalesce("selector_id", F.lit(""))].eqNullSafe(F.col("selector_sha256")) | F.col("selector_id").isNull()
    error = F.raise_error(F.concat(F.coalesce("selector_id", F.lit("null")), F.lit(": unknown selector or other hash"))).cast("string")
    asked = asked.withColumn("selector_sha256", F.when(wrong, error).otherwise(F.col("selector_sha256")))
    out = chosen(tables, registry)
    slides = out.groupBy("deck_id", "selector_id").agg(F.array_sort(F.collect_set("slide")).alias("slides"))
    return asked.join(slides, ["deck_id", "selector_id"], "left")


def affected(failed: DataFrame, registry: Registry, tables: dict[str, DataFrame], tier_slides: list[int] | None = None) -> DataFrame:
    """Failed items with the slides they affect, and those of the tier among them (checklist.failures)."""
    return failures(failed, tables["slides"], named_slides(tables, registry, failed.filter(~F.col("passed"))), tier_slides)


def canary(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Runs of a canary against what is expected, per cohort: names of what differs (pages, scene, score)."""
    from plumbline.operators.rules import mismatched

    j = expected.join(got.withColumnsRenamed({c: f"_{c}" for c in ("pages", "scene", "score")}), "cohort", "left")
    names = mismatched([(c, F.col(c), F.col(f"_{c}")) for c in ("pages", "scene", "score")])
    return j.select("cohort", names.alias("differs"), (names == "").alias("ok"))
