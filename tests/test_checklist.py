from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import api
from plumbline.operators import checklist as C
from plumbline.operators import selectors
from plumbline.operators import release as R
from plumbline.operators import board as B
from plumbline.operators import service as S

RUN = "array<struct<text:string,font:string,size:int,bold:boolean,italic:boolean,language:string>>"
NODES = f"deck_id string, slide int, path array<int>, kind string, placeholder_type string, field_types array<string>, runs {RUN}, cx long, cy long"
RULES = ", ".join(f"{c} {t}" for c, t in C.RULE.items())
SHA = "sha256:" + "1" * 64
OTHER = "sha256:" + "2" * 64


def rule(id, scope="slide", slide=1, tier=1, severity="major", method="object_compare", selector="shape", **more):
    v = dict(id=id, scope=scope, slide=slide if scope == "slide" else None, tier=tier, severity=severity, method=method, selector=selector) | more
    assert set(v) <= set(C.RULE)
    return tuple(v.get(n) for n in C.RULE)


NOTES = selectors.descriptor_hash({"selector_id": "notes-comments", "version": 1})
SLIDE_RULES = [
    rule("shape", selector="shape", required=True, min_count=7), rule("pic", selector="picture", exact_count=1, severity="critical"), rule("table", selector="table", min_count=1, tier=2), rule("chart", selector="chart", min_count=1), rule("connector", selector="connector", min_count=1),
    rule("group", selector="group", min_count=1), rule("field", method="field_check"), rule("text", method="text_match", contains="Hello"), rule("no", method="text_match", not_contains="bye", severity="informational"),
    rule("ph", method="layout_check", selector="placeholder", placeholder_type="title"), rule("layout", method="layout_check", selector="master_ref"), rule("font", method="anti_cheat", selector="font_policy"), rule("raster", method="anti_cheat", selector="no_full_slide_raster", automatic_fail_if=["full_raster", "flattened"], propagation="zero_slide"),
    rule("ssim", method="visual_ssim"), rule("hash", method="hash_match", sha256=SHA), rule("missing", slide=9), rule("odd", method="nonsense", severity="minor"),
]
DECK_RULES = [
    rule("count", "deck", method="object_compare", selector="slide_count", exact_count=2), rule("masters", "deck", method="layout_check", selector="master_count"), rule("layouts", "deck", method="layout_check", selector="layout_count"), rule("notes", "deck", method="anti_cheat", selector="no_notes", automatic_fail_if=["notes"], affected_mode="named_selector", selector_id="notes-comments", selector_sha256=NOTES),
    rule("fonts", "deck", method="anti_cheat", selector="font_policy"), rule("assets", "deck", method="hash_match", asset_hashes={"logo": SHA}), rule("all_ssim", "deck", method="visual_ssim"),
]


@pytest.fixture(scope="module")
def deck(spark):
    run = lambda t, f="Carlito": [(t, f, 1800, None, None, None)]
    n = [("d", 1, [k], kind, None, [], [], 10, 10) for k, kind in enumerate(("picture", "table", "chart", "connector", "group", "shape"))]
    n += [("d", 1, [6], "placeholder", "title", ["slidenum"], run("Hello"), 5, 5), ("d", 1, [7], "field", None, ["datetime"], run("there"), 5, 5), ("d", 2, [0], "text", None, [], run("x"), 1, 1)]
    return {
        "nodes": spark.createDataFrame(n, NODES), "slides": spark.createDataFrame([("d", 1, "l1"), ("d", 2, "l1")], "deck_id string, slide int, layout_ref string"),
        "media": spark.createDataFrame([("d", SHA)], "deck_id string, sha256 string"), "visual": spark.createDataFrame([("d", 1, 1.0), ("d", 2, 1.0)], "deck_id string, slide int, ssim double"),
        "names": spark.createDataFrame([("d", "Master", "m"), ("d", "Layout", "l")], "deck_id string, level string, name string"), "notes": spark.createDataFrame([("d", 1, False, False)], "deck_id string, slide int, notes boolean, comments boolean"),
        "rules": spark.createDataFrame(SLIDE_RULES + DECK_RULES, RULES).cache(), "decks": spark.createDataFrame([("d",)], "deck_id string"),
    }


def grade(t, tier=3):
    return api.grade(t, t["rules"], t["visual"], tier)


def test_positive(deck):
    got = {r.id: r for r in grade(deck).results.collect()}
    assert {i for i, r in got.items() if not r.passed} == {"missing", "odd"}
    assert got["missing"].detail == "slide not found" and got["odd"].detail == "unknown method"
    s = grade(deck).scores.first()
    assert s.total_items == len(got) - 1 and s.fidelity == round(1 - 3 / sum(r.weight for r in got.values()), 4)
    assert grade(deck, 1).scores.first().total_items == s.total_items - 2  # without a rule of tier 2 and one of slide 9


FAULTS = [
    ("nodes", "decrement-picture-count", {"pic", "hash"}), ("nodes", "decrement-table-count", {"table"}), ("nodes", "decrement-chart-count", {"chart"}), ("nodes", "decrement-connector-count", {"connector"}), ("nodes", "decrement-group-count", {"group"}),
    ("nodes", "replace-required-text", {"text"}), ("nodes", "remove-required-placeholder", {"ph"}), ("nodes", "substitute-non-bundled-font", {"font", "fonts"}),
    ("media", "replace-approved-asset-hash", {"hash", "assets"}), ("media", "replace-one-approved-asset-hash", {"hash", "assets"}), ("slides", "clear-layout-reference", {"layout"}), ("visual", "lower-ssim-below-threshold", {"ssim", "all_ssim"}), ("visual", "lower-one-slide-ssim", {"ssim", "all_ssim"}),
    ("names", "decrement-master-count", {"masters"}), ("names", "decrement-layout-count", {"layouts"}),
]


@pytest.mark.parametrize("table,fault,want", FAULTS)
def test_single_faults_are_found(deck, table, fault, want):
    changed = deck | {table: (C.FAULTS | C.TABLE_FAULTS)[fault](deck[table])}
    assert {r.id for r in grade(changed).results.filter("not passed").collect()} - {"missing", "odd"} == want


def test_faults_in_a_decks_row_are_those_in_tables(deck, spark):
    """mutated judges every fault as it is judged when made in a table, and deals no table for it."""
    run = lambda *t: [(x, "Carlito", 1800, None, None, None) for x in t]
    n = [("e", 1, None, "chart", "title", None, None, 1, 1), ("e", 1, [3], "chart", None, [], run("Hello", None, "a\nb"), 9, 9), ("e", 1, [3], "shape", None, ["slidenum"], [], 9, 9), ("e", 1, [4], "chart", "body", [], run("z"), 9, 9)]
    n += [("e", 4, [0], "field", None, ["datetime"], run("not in slides"), 1, 1), ("f", 2, [1], "group", None, [], run("x"), 1, 1)]
    t = deck | {"nodes": deck["nodes"].unionByName(spark.createDataFrame(n, NODES)), "decks": spark.createDataFrame([("d",), ("e",), ("f",), ("none",)], "deck_id string")}
    t["slides"] = t["slides"].unionByName(spark.createDataFrame([("e", 1, None), ("f", 2, "l")], "deck_id string, slide int, layout_ref string"))
    t["media"] = t["media"].unionByName(spark.createDataFrame([("e", OTHER), ("e", SHA)], "deck_id string, sha256 string"))
    t["notes"] = t["notes"].unionByName(spark.createDataFrame([("e", 1, None, None)], t["notes"].schema))
    names = ("nodes", "slides", "media", "visual", "names", "notes", "decks")
    table_of = {f: table for table, f, _ in FAULTS} | {"decrement-shape-count": "nodes", "decrement-field-count": "nodes", "change-exact-slide-count": "slides", "add-speaker-notes-relationship": "notes"}
    assert set(table_of) == set(C.FAULTS | C.TABLE_FAULTS)

    def graded(t, rules):
        facts = C.slide_facts(t["nodes"], t["slides"], t["media"], t["visual"])
        got = C.evaluate_slides(rules, facts, t["decks"]).unionByName(C.evaluate_decks(rules, facts, t["decks"], t["names"], t["notes"], t["visual"], t["media"]))
        return {(r.deck_id, r.id): r.passed for r in got.collect()}

    rules = SLIDE_RULES + DECK_RULES
    some = ["decrement-chart-count", "decrement-shape-count", "decrement-field-count", "replace-required-text", "substitute-non-bundled-font", "change-exact-slide-count", "lower-one-slide-ssim", "add-speaker-notes-relationship"]
    many = spark.createDataFrame([(fault, *r[1:3], k, *r[4:]) for fault in some for k, r in enumerate(rules)], RULES)  # the tier marks the rule
    assert set(C.item_faults(list(table_of))) == {"_nodes", "_slides", "_visual", "hashes", "masters", "layouts", "noted"}
    j = C.mutated(many, C.deck_items(**{c: t[c] for c in names}), "tier").collect()
    base = graded(t, t["rules"])
    for fault in some:
        after = graded(t | {table_of[fault]: (C.FAULTS | C.TABLE_FAULTS)[fault](t[table_of[fault]])}, t["rules"])
        assert sorted((r.deck_id, rules[r.tier][0], r.good, r.bad) for r in j if r.id == fault) == sorted((d, i, base[d, i], after[d, i]) for d, i in base)


def test_mutations_read_each_table_once(spark):
    from plumbline.plans.grading import mutation_matrix

    plan = mutation_matrix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 7 and "Union" not in plan


def test_propagation(deck, spark):
    """Zeroed are the affected slides, not the deck."""
    more = spark.createDataFrame([rule("two", slide=2, selector="text"), rule("three", slide=3, selector="text")], RULES)
    deck = deck | {"rules": deck["rules"].unionByName(more)}
    on_2 = deck | {"notes": spark.createDataFrame([("d", 1, False, False), ("d", 2, True, False)], "deck_id string, slide int, notes boolean, comments boolean")}
    graded = grade(on_2)
    got = {r.id: r for r in graded.results.collect()}
    assert got["pic"].passed and got["two"].outcome == "zeroed_by_anti_cheat" and got["count"].passed and got["odd"].outcome == "failed"
    assert [(r.rule_id, r.disposition, r.affected, r.tier_affected, r.slide) for r in graded.flags.collect()] == [("notes", "warning", [2], [2], None)]
    plain = on_2 | {"rules": on_2["rules"].withColumn("affected_mode", F.lit(None).cast("string"))}
    graded = grade(plain)  # nothing configured: no slide of a deck item is affected
    assert {r.id: r.outcome for r in graded.results.collect()}["two"] == "passed" and graded.flags.first().affected == []

    big = deck["nodes"].withColumns({"cx": F.when(F.col("kind") == "picture", 12_000_000).otherwise(F.col("cx")), "cy": F.when(F.col("kind") == "picture", 6_000_000).otherwise(F.col("cy"))})
    graded = grade(deck | {"nodes": big})
    assert {r.id for r in graded.results.filter("passed and slide is not null").collect()} == {"two"}
    assert sorted((r.rule_id, r.disposition, r.tier_affected) for r in graded.flags.collect()) == [("flattened", "zero_slide", [1]), ("full_raster", "zero_slide", [1])]
    for way, zeroed, disposition in (("zero_affected_slides", False, "zero_affected_slides"), ("zero_item", False, "warning"), ("zero_slide", True, "zero_slide")):
        rules = deck["rules"].withColumn("affected_slides", F.array(F.lit(2), F.lit(30))).withColumn("propagation", F.when(F.col("id") == "raster", way))
        graded = grade(deck | {"nodes": big, "rules": rules})
        got = {r.id: r.outcome for r in graded.results.collect()}
        assert (got["two"] == "zeroed_by_anti_cheat") == zeroed and got["table"] == "passed"
        assert {(r.disposition, tuple(r.affected), tuple(r.tier_affected)) for r in graded.flags.collect()} == {(disposition, (2, 30), (2,))}


def test_expectations(deck, spark):
    rows = [
        rule("kind", method="field_check", field_type="datetime"), rule("no kind", method="field_check", field_type="footer"), rule("exact", slide=2, method="text_match", exact="x"), rule("bogus", method="layout_check", selector="bogus"),
        rule("deck bogus", "deck", method="layout_check", selector="bogus"), rule("deck odd", "deck", method="object_compare", selector="bogus"), rule("deck other", "deck", method="anti_cheat", selector="bogus"),
        rule("some", "deck", method="hash_match", asset_hashes={"a": SHA, "b": OTHER, "c": OTHER}), rule("any", "deck", method="hash_match", asset_hashes={}), rule("low", "deck", method="visual_ssim", min_ssim=0.4), rule("high", "deck", method="visual_ssim"),
        rule("seen", slide=2, method="visual_ssim", min_ssim=0.4), rule("unseen", slide=7, method="visual_ssim", min_ssim=0.4),
    ]
    nodes = deck["nodes"].withColumn("runs", F.transform("runs", lambda r: r.withField("text", F.when(r["text"] == "x", F.lit("\n\u00a0 x\u001f\t")).otherwise(r["text"]))))
    visual = spark.createDataFrame([("d", 2, 0.9, 1), ("d", 2, 0.5, 2), ("d", 2, 0.7, 0)], "deck_id string, slide int, ssim double, ordinal int")
    got = {r.id: r.detail for r in grade(deck | {"rules": spark.createDataFrame(rows, RULES), "nodes": nodes, "visual": visual}).results.collect()}
    assert got == {"kind": "ok", "no kind": "field not found", "exact": "ok", "bogus": "unknown selector", "deck bogus": "unknown selector", "deck odd": "unknown selector", "deck other": "ok", "some": "missing b,c", "any": "ok", "low": "ok", "high": "below threshold", "seen": "ok", "unseen": "slide not found"}
    empty = deck | {"media": deck["media"].limit(0), "visual": visual.limit(0), "rules": spark.createDataFrame(rows, RULES)}
    assert {r.id: r.detail for r in grade(empty).results.collect()}.items() >= {"any": "no media", "low": "no visual result", "seen": "no visual result"}.items()


def test_only_informational_items_score_zero(deck, spark):
    rows = [rule("a", severity="informational"), rule("b", severity="odd")]
    s = grade(deck | {"rules": spark.createDataFrame(rows, RULES)}).scores.first()
    assert (s.fidelity, s.passed_items, s.total_items) == (0.0, 0, 0)


def test_known_scores(spark):
    """Weights sum to 560; 379 and 349 of them give the published percentages."""
    from plumbline.operators.score import fidelity

    sev = ["critical"] * 84 + ["major"] * 112 + ["minor"] * 84
    assert sum({"critical": 3, "major": 2, "minor": 1}[s] for s in sev) == 560
    for weight, want in ((379, 0.6768), (349, 0.6232)):
        left, rows = weight, []
        for s in sorted(sev, key=lambda s: s != "critical"):
            w = {"critical": 3, "major": 2, "minor": 1}[s]
            rows.append(("r", s, left >= w))
            left -= w if left >= w else 0
        assert left == 0 and fidelity(spark.createDataFrame(rows, "k string, severity string, passed boolean"), ["k"]).first().fidelity == want


def test_release_chain(spark):
    t = [dt(2024, 1, d) for d in range(1, 9)]
    rows = [("c", 1, "a", None, "active", t[0], t[0]), ("c", 2, "b", "a", "frozen", t[1], t[2]), ("c", 4, "d", "b", "frozen", t[2], t[3]), ("d", 1, "x", None, "frozen", t[0], t[0]), ("d", 2, "y", "z", "frozen", t[1], t[1]), ("d", 3, "w", "y", "active", t[2], t[2])]
    i = spark.createDataFrame(rows, "chain string, sequence int, sha256 string, previous string, state string, issued_at timestamp, effective_at timestamp")
    assert {(r.chain, r.sequence): r.problem for r in R.chain_problems(i).collect()} == {("c", 1): None, ("c", 2): None, ("c", 4): "gap", ("d", 1): None, ("d", 2): "fork", ("d", 3): "state goes back"}
    state = spark.createDataFrame([("c", 2, "b"), ("d", 2, "other"), ("e", 5, "q")], "chain string, sequence int, sha256 string")
    assert {r.chain: r.verdict for r in R.accepted_head(i, state).collect()} == {"c": "accepted", "d": "fork", "e": "rollback"}


def test_evidence_matrix(spark):
    rows = [(a, b, p, 1.0 - (a + b + p) / 1e7) for a in range(5) for b in range(a + 1, 5) for p in range(3)]
    pairs = spark.createDataFrame(rows, "run_a int, run_b int, page int, ssim double")
    by_pair = pairs.groupBy("run_a", "run_b").agg(F.min("ssim").alias("minimum_ssim"))
    by_page = pairs.groupBy("page").agg(F.min("ssim").alias("minimum_ssim"))
    assert R.matrix_problems(pairs, by_pair, by_page, 5, 3, 0.99).count() == 0
    bad = {r.check for r in R.matrix_problems(pairs.filter("not (run_a = 0 and run_b = 1 and page = 0)"), by_pair, by_page, 5, 3, 0.9999999).collect()}
    assert {"incomplete pairs", "below threshold"} <= bad


def test_robustness_scenario(spark):
    runs = spark.createDataFrame([("g", v, s) for v, s in (("a", 0.9), ("b", 0.82), ("c", 0.86)) for _ in range(3)] + [("h", "a", 0.5)], "g string, v string, s double")
    st = B.campaign_stats(runs, ["g", "v"], "s", F.lit(True))
    assert {r.g: r.robustness for r in B.robustness(st, ["g"], "v", ("a", "b", "c")).collect()} == {"g": 0.82, "h": None}
    one = st.filter("g = 'h'").first()
    assert one.official_mean is None and one.provisional_mean == 0.5 and one.deviation == 0.0


def test_limits_and_claims(spark):
    t = dt(2024, 1, 1)
    e = spark.createDataFrame([(k, 1, t.replace(minute=k)) for k in range(12)] + [(50, 1, t.replace(hour=1, minute=5))], "id int, tenant int, ts timestamp")
    got = {r.id: (r.n, r.limited, r.retry_after) for r in S.rolling_limit(e, "tenant", "ts", "id", 3600, 10).collect()}
    assert got[8][1] is False and got[9] == (10, True, 3600 - 9 * 60) and got[50][0] == 8
    jobs = spark.createDataFrame([(k, 1 if k < 5 else 2) for k in range(8)], "id int, tenant int")
    active = spark.createDataFrame([(1, 3)], "tenant int, running int")
    assert [r.id for r in S.fair_claim(jobs, "tenant", ["id"], active, 5, 4).collect()] == [0, 1, 5, 6]
    slots = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)], "c int, slot int")
    assert {r.c: r.free for r in S.first_free(slots, "c", "slot", 3).collect()} == {1: 2, 2: None}
