"""What a user calls: check, scene_graph, grade, leaderboard."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.arrow import canonical_json
from plumbline.functions.lineage import cut
from plumbline.operators import checklist as C
from plumbline.operators import compiled
from plumbline.operators.diff import tree_diff
from plumbline.operators.selectors import Registry, chosen, default_registry, named_by_deck
from plumbline.sources import canonical, datasource, package, quarantine
from plumbline.sources.sinks import check_output

COMPARED = ["kind", "name", "x", "y", "cx", "cy", "rotation", "placeholder_type", "placeholder_idx", "table_rows", "table_cols", "chart", "field_types", "fill", "shadow", "asset", "runs"]


class Decks:
    """The tables of all packages under a path.

    Each package is opened once, by the data source: its parts are written to the shared folder, and all
    tables but `packages` and `safety` read them there. The source reads stores that pyarrow knows; for
    others (any_store) whole files are read by Spark.
    """

    def __init__(self, spark: SparkSession, path: str, any_store: bool = False):
        self.packages = package.packages(spark, path)
        self.parts = cut(package.parts(self.packages) if any_store else datasource.parts(spark, path))
        good = self.parts.filter("problem is null")
        self.relationships = package.relationships(good)
        self.slides = package.slides(good, self.relationships)
        self.nodes = package.nodes(good, self.relationships, self.slides) if any_store else datasource.nodes(good)
        self.media, self.names = package.media(good), package.layout_names(good)
        self.notes = package.notes_and_comments(self.relationships, self.slides)
        self.safety = quarantine.safety(self.packages)
        self.digests = package.package_digest(self.parts)
        self.identities = canonical.identities(self.packages)
        self.orphans = package.orphans(good, self.relationships)
        self.problems = package.xml_problems(good).unionByName(package.slide_problems(good, self.relationships).withColumn("part_name", F.lit(package.PRESENTATION)))

    def as_checked(self) -> dict[str, DataFrame]:
        """Tables named as operators.checklist wants them."""
        to = lambda df: df.withColumnRenamed("package_id", "deck_id")
        layout = self.relationships.filter("type = 'slidelayout'").select("package_id", F.col("source").alias("part_name"), F.col("target").alias("layout_ref"))
        slides = self.slides.join(layout, ["package_id", "part_name"], "left").select("package_id", "slide", F.coalesce("layout_ref", F.lit("")).alias("layout_ref"))
        return {"nodes": to(self.nodes), "slides": to(slides), "media": to(self.media), "names": to(self.names), "notes": to(self.notes), "decks": to(self.packages.select("package_id"))}


def check(submission: Decks, reference: Decks) -> DataFrame:
    """Structural differences of equally named packages: package_id, slide, path, change_type, changed_fields."""
    return tree_diff(reference.nodes, submission.nodes, ["package_id", "slide", "path"], COMPARED)


def check_result(submission: Decks, reference: Decks) -> tuple[int, str]:
    """Exit code (0 same, 1 changed) and JSON."""
    return check_output(check(submission, reference))


def scene_graph(decks: Decks, slides: list[int] | None = None) -> DataFrame:
    """Canonical JSON of every slide: package_id, slide, scene; nodes in the order of their paths."""
    n = decks.nodes if slides is None else decks.nodes.filter(F.col("slide").isin(*slides))
    node = F.struct("path", *[c for c in n.columns if c not in ("package_id", "slide", "path", "part_name")])
    g = n.groupBy("package_id", "slide").agg(F.array_sort(F.collect_list(F.struct("path", F.to_json(node).alias("j")))).alias("nodes"))
    text = F.concat(F.lit("["), F.array_join(F.transform("nodes", lambda x: x["j"]), ","), F.lit("]"))
    return g.select("package_id", "slide", canonical_json(text).alias("scene"))


class Graded(NamedTuple):
    results: DataFrame  # items: deck_id, id, slide, severity, passed, detail, outcome, weight
    scores: DataFrame  # of the decks: fidelity, passed_items, total_items
    flags: DataFrame  # anti-cheat rules that failed items stand for, with the slides they affect


def grade(tables: dict[str, DataFrame], rules: DataFrame, visual: DataFrame, tier: int = 3, registry: Registry | None = None) -> Graded:
    """A checklist on the slides of a tier. tables: Decks.as_checked(); rules: columns of checklist.RULE."""
    last = C.TIER_SLIDES[tier - 1]
    rules = C.completed(rules).filter(F.col("tier") <= tier).filter(F.col("slide").isNull() | F.col("slide").between(1, last))
    registry = registry or default_registry()
    known = {i: sha for i, (sha, _) in registry.known().items()}
    if len(few := rules.limit(compiled.MOST_RULES + 1).collect()) <= compiled.MOST_RULES:
        results, failed = compiled.graded(tables, visual, chosen(tables, registry), few, known, last)
        return Graded(results, C.tier_score(results, tier), C.flags(failed))
    facts = C.deck_facts(tables["decks"], tables["nodes"], tables["slides"], tables["media"], visual, tables["names"], tables["notes"])
    decks = facts.join(named_by_deck(tables, registry), "deck_id", "left")
    results = C.settled(C.evaluate(rules, decks), registry.hashes(), list(range(1, last + 1)))
    return Graded(results, C.tier_score(results, tier), C.flags(results.filter("affected is not null")))
