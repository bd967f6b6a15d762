"""Checklists as columns: what each rule asks of a deck is an aggregate of its own, what it finds a column of the deck's row.

Rules are read once, so that an expression has only the checks of its rule's method, on native aggregates; the items are
unfolded last. Results are those of checklist.evaluate and settled, which take any number of rules as rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.functions.text import strip_unicode
from plumbline.operators import checklist as C
from plumbline.operators.score import WEIGHTS

#: More rules than these are evaluated as rows.
MOST_RULES = 400
Case = tuple[Column, Column | str]


class Facts:
    """The facts that rules ask of a deck, each once: by table, name and aggregate over the table's rows."""

    def __init__(self):
        self.asked: dict[str, dict[tuple, tuple[str, Column]]] = {}

    def get(self, table: str, key: tuple, aggregate: Column) -> Column:
        t = self.asked.setdefault(table, {})
        return F.col(t.setdefault(key, (f"_{table}_{len(t)}", aggregate))[0])

    def count(self, table: str, key: tuple, condition: Column) -> Column:
        return F.coalesce(self.get(table, key, F.count_if(condition)), F.lit(0))

    def of(self, table: str) -> list[Column]:
        return [aggregate.alias(name) for name, aggregate in self.asked.get(table, {}).values()]

    def slides(self, table: str) -> list[int]:
        """The slides that a table's facts are about; None stands for all."""
        return sorted({key[0] for key in self.asked.get(table, {})}, key=lambda s: (s is not None, s))

    def number(self, slide: int, selector: str | None) -> Column:
        """How many nodes of a slide a selector names; any other selector names a kind."""
        ways = {"shape": F.col("kind").isin(*C.DRAWN), "placeholder": F.col("placeholder_type").isNotNull(), "field": F.size("field_types") > 0}
        return F.lit(0) if selector is None else self.count("nodes", (slide, "number", selector), (F.col("slide") == slide) & ways.get(selector, F.col("kind") == selector))

    def text(self, slide: int) -> Column:
        texts = F.collect_list(F.when(F.col("slide") == slide, F.struct("path", "t")))
        return F.coalesce(self.get("texts", (slide,), F.array_join(F.transform(F.array_sort(texts), lambda x: x["t"]), " ")), F.lit(""))

    def fonts(self, slide: int | None) -> Column:
        """Fonts outside the list, sorted and comma-joined, of a slide or of all that are in slides."""
        here = F.col("fonts") if slide is None else F.when(F.col("slide") == slide, F.col("fonts"))
        return F.coalesce(self.get("fonts", (slide,), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(here)))), ",")), F.lit(""))

    def hash(self, sha256: str) -> Column:
        return self.count("decks", ("sha256", sha256), F.col("sha256") == sha256)

    def named(self, selector: str, slide: int) -> Column:
        return self.count("named", (slide, selector), (F.col("selector_id") == selector) & (F.col("slide") == slide)) > 0

    def all_named(self, selector: str) -> Column:
        return F.coalesce(self.get("named", (None, selector), F.array_sort(F.collect_set(F.when(F.col("selector_id") == selector, F.col("slide"))))), F.array().cast("array<int>"))


def slide_cases(r: Row, facts: Facts) -> list[Case]:
    """What can be wrong with a slide by its rule, in the order of checklist.slide_checks."""
    here, s = F.col("slide") == r.slide, r.selector
    missing = (facts.count("slides", (r.slide, "present"), here) == 0, "slide not found")
    if r.method == "object_compare":
        n = facts.number(r.slide, s)
        found = [(n == 0, "required but missing")] if r.required else []
        found += [(n != r.exact_count, "exact count differs")] if r.exact_count is not None else []
        found += [(n < r.min_count, "too few")] if r.min_count else []
    elif r.method == "text_match":
        found = [(~facts.text(r.slide).contains(r.contains), "missing text")] if r.contains else []
        found += [(strip_unicode(facts.text(r.slide)) != r.exact, "text differs")] if r.exact else []
        found += [(facts.text(r.slide).contains(r.not_contains), "forbidden text")] if r.not_contains else []
    elif r.method == "hash_match":
        found = [(facts.number(r.slide, "picture") == 0, "no picture")]
        found += [(facts.hash(r.sha256) == 0, "hash not found")] if r.sha256 else []
    elif r.method == "field_check" and r.field_type:  # a field without a type may be any
        has = F.col("field_types").isNotNull() & F.coalesce(F.array_contains("field_types", r.field_type), F.lit(True))
        found = [(facts.count("nodes", (r.slide, "field", r.field_type), here & has) == 0, "field not found")]
    elif r.method == "field_check":
        found = [(facts.number(r.slide, "field") == 0, "no field")]
    elif r.method == "layout_check" and s == "master_ref":
        given, empty = facts.count("slides", (r.slide, "layout"), here & F.col("layout_ref").isNotNull()), facts.count("slides", (r.slide, "empty"), here & (F.col("layout_ref") == ""))
        found = [((given == 0) | (empty > 0), "no layout")]
    elif r.method == "layout_check" and s == "placeholder":
        n = facts.count("nodes", (r.slide, "holder", r.placeholder_type), here & (F.col("placeholder_type") == r.placeholder_type)) if r.placeholder_type else facts.number(r.slide, s)
        found = [(n < (1 if r.min_count is None else r.min_count), "too few placeholders")]
    elif r.method == "layout_check":
        found = [(F.lit(True), "unknown selector")]
    elif r.method == "anti_cheat":
        fonts = (facts.fonts(r.slide) != "", F.concat(F.lit("fonts "), facts.fonts(r.slide))) if s == "font_policy" else None
        raster = (facts.count("nodes", (r.slide, "raster"), here & (F.col("area") > C.RASTER)) > 0, "full-slide raster") if s == "no_full_slide_raster" else None
        found = [x for x in (fonts, raster) if x]
    elif r.method == "visual_ssim":
        found = low(facts.get("visual", (r.slide,), F.max(F.when(here, F.col("ssim")))), r)
    else:
        found = [(F.lit(True), "unknown method")]
    return [missing, *found]


def deck_cases(r: Row, facts: Facts) -> list[Case]:
    """What can be wrong with a deck by its rule, in the order of checklist.deck_checks."""
    s = r.selector
    at_least = lambda level: facts.count("decks", ("level", level), F.col("level") == level) < (1 if r.min_count is None else r.min_count)
    if r.method == "object_compare" and s == "slide_count":
        return [(F.coalesce(facts.get("slides", (None,), F.count(F.lit(1))), F.lit(0)) != (20 if r.exact_count is None else r.exact_count), "slide count differs")]
    if r.method == "layout_check" and s in ("master_count", "layout_count"):
        return [(at_least("Master"), "too few masters") if s == "master_count" else (at_least("Layout"), "too few layouts")]
    if r.method in ("object_compare", "layout_check"):
        return [(F.lit(True), "unknown selector")]
    if r.method == "anti_cheat":
        fonts = (facts.fonts(None) != "", F.concat(F.lit("fonts "), facts.fonts(None))) if s == "font_policy" else None
        notes = (facts.count("decks", ("noted",), F.col("noted")) > 0, "notes or comments") if s == "no_notes" else None
        return [x for x in (fonts, notes) if x]
    if r.method == "hash_match" and r.asset_hashes:
        lost = [(facts.hash(v) == 0, k) for k, v in sorted(r.asset_hashes.items(), key=lambda x: x[0].encode()) if v is not None]
        names = F.array_join(F.array(*(F.when(gone, F.lit(k)) for gone, k in lost)), ",")
        return [(reduce(lambda a, b: a | b, (gone for gone, _ in lost)), F.concat(F.lit("missing "), names))] if lost else []
    if r.method == "hash_match":
        return [(facts.count("decks", ("media",), F.col("sha256").isNotNull()) == 0, "no media")]
    if r.method == "visual_ssim":
        return low(facts.get("visual", (None,), F.min("ssim")), r)
    return [(F.lit(True), "unknown method")]


def low(ssim: Column, r: Row) -> list[Case]:
    return [(ssim.isNull(), "no visual result"), (ssim < (C.DEFAULT_SSIM if r.min_ssim is None else r.min_ssim), "below threshold")]


def fault(r: Row, facts: Facts, known: dict[str, str]) -> Column:
    """What is wrong by a rule, null where nothing is. A fault of a rule that names another selector or hash is an error."""
    wrong = r.affected_mode == "named_selector" and (r.selector_id is None or known.get(r.selector_id) != r.selector_sha256)
    error = F.raise_error(F.lit(f"{'null' if r.selector_id is None else r.selector_id}: unknown selector or other hash")).cast("string")
    cases = deck_cases(r, facts) if r.scope == "deck" else slide_cases(r, facts)
    text = lambda x: error if wrong else F.lit(x) if isinstance(x, str) else x
    return reduce(lambda out, x: out.when(x[0], text(x[1])), cases, F).otherwise(F.lit(None).cast("string")) if cases else F.lit(None).cast("string")


def table(rows: list[tuple], kind: str) -> Callable[[Column], Column]:
    """Row k of a constant table."""
    names = [x.split(" ")[0] for x in kind.split(", ")]
    kinds = [x.split(" ")[1] for x in kind.split(", ")]
    cell = lambda v, t: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(t)
    all_rows = F.array(*(F.struct(*(cell(v, t).alias(n) for v, t, n in zip(row, kinds, names))) for row in rows))
    return lambda k: F.get(all_rows.cast(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>"), k)


def graded(tables: dict[str, DataFrame], visual: DataFrame, named: DataFrame, rules: list[Row], known: dict[str, str], last: int) -> tuple[DataFrame, DataFrame]:
    """Items of every deck, and its failures as checklist.flags wants them. named: deck_id, slide, selector_id."""
    rules = [r for r in rules if r.scope == "deck" or (r.scope is not None and r.slide is not None)]
    facts, none = Facts(), F.array().cast("array<int>")
    faults = [fault(r, facts, known) for r in rules]
    stands = [k for k, r in enumerate(rules) if r.automatic_fail_if]
    by_name = [r.affected_mode == "named_selector" for r in rules]

    def listed(r: Row) -> list:
        given = sorted({s for s in r.affected_slides or [] if s is not None}) + [None] * (None in (r.affected_slides or []))
        return given or ([r.slide] if r.scope != "deck" else [])

    def takes(k: int, slide: int) -> Column | None:
        r, failed = rules[k], F.get("_faults", F.lit(k)).isNotNull()
        if not (r.scope == "deck" or r.propagation == "zero_slide"):
            return None
        return failed & facts.named(r.selector_id, slide) if by_name[k] and r.selector_id is not None else failed if not by_name[k] and slide in listed(r) else None

    zeroed = [reduce(lambda a, b: a | b, (x for k in stands if (x := takes(k, s)) is not None), F.lit(False)) for s in range(1, last + 1)]
    selectors = sorted({rules[k].selector_id for k in stands if by_name[k] and rules[k].selector_id is not None})
    all_named = {s: facts.all_named(s) for s in selectors}
    decks = joined(tables, visual, named.filter(F.col("selector_id").isin(*selectors)) if selectors else named, facts)
    decks = decks.withColumn("_faults", F.array(*faults).cast("array<string>"))

    of = table([(r.id, None if r.scope == "deck" else r.slide, r.tier, r.severity, WEIGHTS.get(r.severity, 0)) for r in rules], "id string, slide int, tier int, severity string, weight int")
    numbers = lambda ks: F.explode(F.array(*map(F.lit, ks)).cast("array<int>")).alias("_k")
    items = decks.withColumn("_zeroed", F.array(*zeroed)).select("deck_id", "_zeroed", "_faults", numbers(range(len(rules)))).withColumns({"_fault": F.get("_faults", F.col("_k")), "_r": of(F.col("_k"))})
    taken = F.col("_fault").isNull() & F.coalesce(F.get("_zeroed", F.col("_r.slide") - 1), F.lit(False))
    outcome = F.when(F.col("_fault").isNotNull(), "failed").when(taken, "zeroed_by_anti_cheat").otherwise("passed")
    detail = F.when(taken, F.concat(F.lit("zeroed on slide "), F.col("_r.slide").cast("string"))).otherwise(F.coalesce("_fault", F.lit("ok")))
    items = items.select("deck_id", "_r.id", "_r.slide", "_r.tier", "_r.severity", (F.col("_fault").isNull() & ~taken).alias("passed"), detail.alias("detail"), outcome.alias("outcome"), "_r.weight")

    kept = [(r.id, None if r.scope == "deck" else r.slide, list(r.automatic_fail_if or []), r.propagation, r.selector_id if by_name[k] else None, [] if by_name[k] else listed(r)) for k, r in enumerate(rules)]
    of = table(kept, "id string, slide int, automatic_fail_if array<string>, propagation string, _selector string, _listed array<int>")
    failed = decks.select("deck_id", "_faults", *(a.alias(f"_all_{n}") for n, a in enumerate(all_named.values())), numbers(stands))
    failed = failed.withColumn("detail", F.get("_faults", F.col("_k"))).filter("detail is not null").withColumn("_r", of(F.col("_k")))
    affected = reduce(lambda out, x: F.when(F.col("_r._selector") == x[1], F.col(f"_all_{x[0]}")).otherwise(out), enumerate(all_named), F.coalesce("_r._listed", none))
    failed = failed.select("deck_id", "_r.id", "_r.slide", "_r.automatic_fail_if", "_r.propagation", affected.alias("affected"), "detail")
    within = F.array(*(F.lit(x) for x in range(1, last + 1))).cast("array<int>")
    return items, failed.withColumn("tier_affected", F.array_sort(F.array_intersect("affected", within)))


def joined(tables: dict[str, DataFrame], visual: DataFrame, named: DataFrame, facts: Facts) -> DataFrame:
    """A row for each row of decks, with its facts: every table is aggregated by deck and dealt by it once. Decks, media,
    names and notes are one table with few columns."""
    parts = [tables["decks"].select("deck_id", F.lit(1).alias("_deck"))]
    asked = {key[0] for key in facts.asked.get("decks", {})}
    more = {"sha256": ("media", F.col("sha256")), "level": ("names", F.col("level")), "noted": ("notes", F.col("notes") | F.col("comments"))}
    for c, (name, value) in more.items():
        if c in asked or (c == "sha256" and "media" in asked):
            parts.append(tables[name].filter("deck_id is not null").select("deck_id", value.alias(c)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("deck_id").agg(F.count("_deck").cast("int").alias("_decks"), *facts.of("decks"))
    out = out.withColumn("_deck", F.explode(F.array_repeat(F.lit(1), F.col("_decks")))).drop("_deck", "_decks")

    def only(df: DataFrame, name: str) -> DataFrame:
        slides = facts.slides(name)
        return df if None in slides else df.filter(F.col("slide").isin(*slides))

    area, text, fonts = C.node_facts()
    nodes = tables["nodes"]
    ways = {
        "nodes": lambda: only(nodes, "nodes").select("deck_id", "slide", "kind", "placeholder_type", "field_types", area.alias("area")),
        "texts": lambda: only(nodes, "texts").filter(F.size("runs") > 0).select("deck_id", "slide", "path", text.alias("t")),
        "fonts": lambda: only(nodes, "fonts").select("deck_id", "slide", fonts.alias("fonts")).filter(F.size("fonts") > 0).join(only(tables["slides"], "fonts").select("deck_id", "slide"), ["deck_id", "slide"], "left_semi"),
        "slides": lambda: only(tables["slides"], "slides"),
        "visual": lambda: C.last_results(only(visual, "visual").repartition("deck_id")),
        "named": lambda: named,
    }
    for name, rows in ways.items():
        if aggregates := facts.of(name):
            out = out.join(rows().groupBy("deck_id").agg(*aggregates), "deck_id", "left")
    return out
