"""Checklists compiled to columns: the same items as rules joined as rows, and a plan in which nothing is looked up by item."""

import pytest
from test_checklist import DECK_RULES, NODES, NOTES, OTHER, RULES, SHA, SLIDE_RULES, rule

from plumbline import api
from plumbline.operators import compiled
from plumbline.plans import grading

ODD = [
    rule("no kind", selector=None, min_count=1), rule("any", min_count=None), rule("none", selector="picture", exact_count=0), rule("holders", selector="placeholder", min_count=2), rule("fields", selector="field", exact_count=1), rule("least", selector="shape", min_count=-1),
    rule("kind", method="field_check", field_type="date"), rule("kind 2", slide=2, method="field_check", field_type="date"), rule("all", method="text_match", contains="a", exact="a b", not_contains="c"), rule("layout 2", slide=2, method="layout_check", selector="master_ref"), rule("layout 3", slide=3, method="layout_check", selector="master_ref"),
    rule("holder", method="layout_check", selector="placeholder", min_count=0), rule("font 1", slide=3, method="anti_cheat", selector="font_policy", automatic_fail_if=["f", "g"], propagation="zero_slide", affected_slides=[3, 1, 3, None]), rule("zero", slide=2, method="visual_ssim", min_ssim=0.0), rule("other", method="hash_match", sha256=OTHER),
    rule("null method", method=None), rule("scope", None, slide=1), rule("nowhere", slide=None), rule("deck on", "deck", method="visual_ssim", min_ssim=0.95, automatic_fail_if=["low"], affected_slides=[2]), rule("some", "deck", method="hash_match", asset_hashes={"é": SHA, "z": OTHER, "n": None}), rule("media", "deck", method="hash_match"),
    rule("null selector", "deck", method="anti_cheat", selector=None), rule("named", method="text_match", contains="q", automatic_fail_if=["n"], propagation="zero_slide", affected_mode="named_selector", selector_id="notes-comments", selector_sha256=NOTES), rule("plain", "deck", method="nonsense", severity=None),
]


@pytest.fixture(scope="module")
def tables(spark):
    run = lambda *t: [(x, f, 1800, None, None, None) for x, f in t]
    nodes = [
        ("a", 1, [2], "picture", None, None, run(("b", "Carlito")), 12_000_000, 6_000_000), ("a", 1, [1], "shape", "title", ["date", None], run(("a", "Odd"), (None, None)), 1, 1), ("a", 2, None, "field", None, ["x", None], None, None, 1), ("a", 2, [1], "text", "body", [], [], 1, 1),
        ("a", 3, [1], "chart", "title", ["y"], run(("c", "B"), ("d", "A")), 1, 1), ("a", 9, [1], "chart", None, [], run(("c", "Not in slides")), 1, 1), ("b", 1, [1], None, "", ["y"], run(("a b", "+mn")), 1, 1), ("b", None, [1], "shape", None, [], run(("x", "Null")), 1, 1), (None, 1, [1], "shape", None, [], run(("x", "Null")), 1, 1),
    ]
    return {
        "nodes": spark.createDataFrame(nodes, NODES), "slides": spark.createDataFrame([("a", 1, "l"), ("a", 2, None), ("a", 3, ""), ("a", 3, "l"), ("b", 1, "l"), ("b", None, "l"), (None, 1, "l")], "deck_id string, slide int, layout_ref string"),
        "media": spark.createDataFrame([("a", SHA), ("b", None), (None, OTHER)], "deck_id string, sha256 string"), "names": spark.createDataFrame([("a", "Master", "m"), ("b", "Layout", "l"), (None, "Layout", "l")], "deck_id string, level string, name string"),
        "notes": spark.createDataFrame([("a", 1, None, True), ("a", 2, True, None), ("b", 1, None, False), (None, 1, True, True)], "deck_id string, slide int, notes boolean, comments boolean"), "decks": spark.createDataFrame([("a",), ("b",), ("b",), ("none",), (None,)], "deck_id string"),
        "visual": spark.createDataFrame([("a", 1, 0.9, 2), ("a", 1, 1.0, 1), ("a", 2, None, 1), ("b", 1, 1.0, 1), ("b", 2, 0.99, None)], "deck_id string, slide int, ssim double, ordinal int"),
    }


def test_items_are_those_of_rules_as_rows(spark, tables, monkeypatch):
    rules = spark.createDataFrame(SLIDE_RULES + DECK_RULES + ODD, RULES)
    few = api.grade(tables, rules, tables["visual"])
    monkeypatch.setattr(compiled, "MOST_RULES", 3)
    many = api.grade(tables, rules, tables["visual"])
    assert few.results.columns == ["deck_id", "id", "slide", "tier", "severity", "passed", "detail", "outcome", "weight"]
    for a, b in ((few.results, many.results.select(few.results.columns)), (few.flags, many.flags), (few.scores, many.scores)):
        a, b = (sorted(map(str, x.select(b.columns).collect())) for x in (a, b))
        assert a == b and a
    assert {r.outcome for r in few.results.select("outcome").distinct().collect()} == {"passed", "failed", "zeroed_by_anti_cheat"}


def test_no_rules_and_wrong_selectors(spark, tables):
    none = api.grade(tables, spark.createDataFrame([], RULES), tables["visual"])
    assert none.results.count() == none.flags.count() == none.scores.count() == 0
    wrong = [rule("w", slide=7, affected_mode="named_selector", selector_id="notes-comments", selector_sha256="other")]
    with pytest.raises(Exception, match="unknown selector or other hash"):
        api.grade(tables, spark.createDataFrame(wrong, RULES), tables["visual"]).results.collect()
    right = [rule("r", slide=7, affected_mode="named_selector", selector_id="notes-comments", selector_sha256=NOTES)]
    assert api.grade(tables, spark.createDataFrame(right, RULES), tables["visual"]).results.count() == 5


def test_items_look_nothing_up(spark):
    """Before, every item searched its deck's arrays and met the deck's other items in a window; 22 items a deck are most of the job."""
    plan = grading.grade_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join Cross" not in plan and "Join Inner" not in plan
    top = plan.split("Generate explode")[0]
    assert "lambda" not in top and plan.count("_faults") < 60
