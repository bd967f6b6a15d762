import random
import re

import pytest
from pyspark.sql import functions as F
from test_package import NS, deck

from plumbline.operators import content as X
from plumbline.sources import package


def pattern(p: X.Particle) -> str:
    """The declaration as a regular expression over one-letter names."""
    inner = p.name if p.name is not None else ("|" if p.choice else "").join(map(pattern, p.parts))
    return f"(?:{inner}){{{p.least},{'' if p.most is None else p.most}}}"


def particle(rng, depth=0) -> X.Particle:
    least = rng.choice([0, 1, 1, 2])
    times = {"least": least, "most": rng.choice([None, max(1, least), least + 1])}
    if depth == 3 or rng.random() < 0.4:
        return X.child(rng.choice("abc"), **times)
    return (X.choice if rng.random() < 0.4 else X.sequence)(*(particle(rng, depth + 1) for _ in range(rng.choice([1, 2, 3]))), **times)


@pytest.mark.parametrize("seed", range(60))
def test_automata_take_what_the_expression_matches(seed):
    rng = random.Random(seed)
    p = particle(rng)
    moves, final, expected = X.automaton(p)
    whole = re.compile(pattern(p))
    for _ in range(200):
        word, state = [rng.choice("abc") for _ in range(rng.randrange(7))], 0
        for c in word:
            assert (f"{state} {c}" in moves) == (c in expected[state].split())
            state = moves.get(f"{state} {c}")
            if state is None:
                break
        assert (state is not None and state in final) == bool(whole.fullmatch("".join(word))), (word, pattern(p))


def test_too_many_places():
    with pytest.raises(ValueError):
        X.automaton(X.sequence(X.child("a", 0, 100), least=0, most=100))


DECLARED = {"list": X.Declaration(X.sequence(X.child("head"), X.child("item", 1, 3), X.child("tail", 0)), {"id": True, "name": False}), "empty": X.Declaration()}


@pytest.mark.parametrize("children,want", [(["head", "item"], []), (["head", "item", "item", "tail"], []), (["item"], [("unexpected child", 1, "item, expected head")]), (["head"], [("missing child", 2, "expected item")]), (["head", "item", "item", "item", "item"], [("unexpected child", 5, "item, expected tail")]), (["head", "item", "tail", "tail"], [("unexpected child", 4, "tail, expected nothing")]), ([], [("missing child", 1, "expected head")]), (None, [("missing child", 1, "expected head")])])
def test_children(spark, children, want):
    df = spark.createDataFrame([("k", "list", children, {"id": "1"})], "key string, model string, children array<string>, attributes map<string,string>")
    assert [tuple(r)[1:] for r in X.check(df, X.compiled(spark, DECLARED)).collect()] == want


def test_attributes_and_unknown_elements(spark):
    df = spark.createDataFrame([(1, "empty", None, None), (2, "empty", ["x"], {"y": "1", "a": ""}), (3, "list", ["head", "item"], {"name": "n"}), (4, "other", [], {}), (5, None, None, None)], "key int, model string, children array<string>, attributes map<string,string>")
    assert sorted((r.key, r.problem, r.detail) for r in X.check(df, X.compiled(spark, DECLARED)).collect() if r.key < 5) == [(2, "undeclared attribute", "a"), (2, "undeclared attribute", "y"), (2, "unexpected child", "x, expected nothing"), (3, "missing attribute", "id"), (4, "undeclared element", "other")]
    assert X.check(df.filter("false"), X.compiled(spark, DECLARED)).count() == 0 and X.check(df, X.compiled(spark, DECLARED)).filter("key = 5").count() == 1


P = package.P
SIZE = '<p:sldSz cx="12192000" cy="6858000"/>'
PART = "ppt/presentation.xml"
KIND = "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"


def presentation(inner):
    return f"<p:presentation {NS}>{inner}</p:presentation>"


def types(*more):
    return '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="XML" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{n}" ContentType="{k}"/>' for n, k in more) + "</Types>"


def test_packages(spark):
    """Of packages with one presentation each: what is wrong, and whether the validation was complete."""
    drop = {n: "" for n in ("ppt/slides/a.xml", "ppt/slides/b.xml", "ppt/slideMasters/m.xml", "ppt/notes/n.xml")}
    declared = {f"{P}presentation": X.Declaration(X.sequence(X.child(f"{P}sldIdLst", 0), X.child(f"{P}sldSz"))), f"{P}sldSz": X.Declaration(X.sequence(), {"cx": True, "cy": True}), f"{P}sldIdLst": X.Declaration()}
    roots = spark.createDataFrame([(KIND, f"{P}presentation", "pml")], "content_type string, root string, schema string")

    def pack(inner, *more, **parts):
        return deck(**drop, **{PART: presentation(inner), "[Content_Types].xml": types((PART, KIND), *more)}, **parts)

    decks = {
        "fine": pack(SIZE), "small": pack('<p:sldSz cx="12192000" cy="6857999"/>'), "none": pack(""), "two": pack(SIZE + SIZE), "order": pack(SIZE + "<p:sldIdLst/>"), "words": pack('<p:sldSz cx="wide" cy="1"/>'), "bogus": pack('<p:sldSz cx="12192000" cy="6858000" z="1"/>'),
        "opaque": pack(SIZE, ("ppt/x.xml", "application/x-opaque+xml"), **{"ppt/x.xml": "<x/>"}), "broken": pack(SIZE, **{"ppt/x.xml": "<x"}), "default": deck(**drop, **{PART: presentation(SIZE), "[Content_Types].xml": types()}), "untyped": deck(**drop, **{PART: presentation(SIZE), "[Content_Types].xml": "<Types/>"}),
    }
    part = package.parts(spark.createDataFrame(list(decks.items()), "package_id string, content binary")).filter("length(content) > 0").cache()
    found, verdict = X.validate(package.elements(part), package.content_types(part), roots, X.compiled(spark, declared), part, (PART, f"{P}sldSz"))
    problems = {}
    for r in found.collect():
        problems.setdefault(r.package_id, set()).add(r.problem)
    assert problems == {
        "small": {"slide size"}, "none": {"slide size", "missing child"}, "two": {"slide size", "unexpected child"}, "order": {"unexpected child"}, "words": {"slide size"}, "bogus": {"undeclared attribute"},
        "opaque": {"unmapped part"}, "broken": {"malformed XML"}, "default": {"unmapped part"}, "untyped": {"no content type"},
    }
    v = {r.package_id: (r.relevant, r.validated, r.performed, r.valid) for r in verdict.collect()}
    assert v["fine"] == (1, 1, True, True) and v["small"] == (1, 1, True, False) and v["opaque"] == (2, 1, False, False) and v["broken"] == (2, 1, False, False) and v["default"] == (1, 0, False, False)


def test_elements(spark):
    part = package.parts(spark.createDataFrame([("d", deck())], "package_id string, content binary"))
    e = package.elements(part).filter(F.col("part_name") == PART)
    assert [(r.path, r.model.removeprefix(P), [c.removeprefix(P) for c in r.children]) for r in e.orderBy("path").collect()] == [([], "presentation", ["sldIdLst"]), ([0], "sldIdLst", ["sldId", "sldId"]), ([0, 0], "sldId", []), ([0, 1], "sldId", [])]
