import json

from test_checklist import RULES, rule
from test_package import deck, shape, slide

from plumbline import api
from plumbline.operators import integrity


def test_check_scene_and_grade(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/d.pptx").write_bytes(deck())
    (tmp_path / "b/d.pptx").write_bytes(deck(**{"ppt/slides/b.xml": slide(shape("x", "Changed", font="Comic"))}))
    a, b = api.Decks(spark, str(tmp_path / "a")), api.Decks(spark, str(tmp_path / "b"))
    assert api.check_result(a, a) == (0, '{"status": "same", "changed_objects": 0, "changes": []}')
    code, text = api.check_result(b, a)
    found = json.loads(text)
    assert code == 1 and [(c["slide"], c["path"], c["change_type"]) for c in found["changes"]] == [(1, [0], "changed"), (1, [1], "missing")]
    scene = {r.slide: json.loads(r.scene) for r in api.scene_graph(a).collect()}
    assert [n["node_id"] for n in scene[2]] == ["s2:n0", "s2:n1", "s2:n1.0", "s2:n1.1", "s2:n2"]
    assert api.scene_graph(a, [1]).count() == 1
    rules = spark.createDataFrame([rule("title", slide=2, method="text_match", contains="Hello"), rule("font", slide=1, method="anti_cheat", selector="font_policy"), rule("notes", "deck", method="anti_cheat", selector="no_notes")], RULES)
    results, score, flags = api.grade(a.as_checked(), rules, spark.createDataFrame([], "deck_id string, slide int, ssim double"))
    assert {r.id: r.passed for r in results.collect()} == {"title": True, "font": False, "notes": False}
    assert score.first().fidelity == round(1 / 3, 4) and flags.count() == 0
    assert integrity.scene_numbering(a.nodes).count() == 0
    assert integrity.scene_numbering(a.nodes.filter("node_id <> 's2:n1'")).count() > 0
    assert a.safety.first().verdict == "ok" and a.digests.count() == 1 and a.orphans.count() == 2


def test_integrity(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    src = spark.createDataFrame([("s", "one\ntwo\nthree")], "source_id string, text string")
    req = spark.createDataFrame([("ok", "s", 2, 3, sha("two\nthree")), ("bad", "s", 1, 1, sha("two")), ("lost", "t", 1, 1, sha("one"))], "requirement_id string, source_id string, line_start int, line_end int, excerpt_sha256 string")
    assert {r.subject for r in integrity.recorded_excerpts(req, src).collect()} == {"bad", "lost"}
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "k string, v string"), spark.createDataFrame([("x", "1"), ("z", "2")], "k string, v string")
    assert {r.subject for r in integrity.same_values(a, b, "facts", "k", "v").collect()} == {"y", "z"}
