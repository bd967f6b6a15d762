import json

from plumbline.operators import facts


def test_any_depth(spark):
    deep = "leaf"
    for k in range(12):
        deep = {"k": deep} if k % 2 else [deep]
    docs = {1: {"a": {"b/c": [1, 2.5, "1", True, None, {}, []], "~": "x"}, "": 0}, 2: [], 3: "text", 4: {"deep": deep}, 5: {"big": 12345678901234567890, "e": 1e300, "neg": -7}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [(6, "{bad"), (7, None), (1, '{"again": 1}')], "k long, doc string")
    got = sorted((r.k, r.path, r.type, r.value or "") for r in facts.flat(df, ["k"], "doc").collect())
    want = [
        (1, "/", "integer", "0"), (1, "/a/b~1c/0", "integer", "1"), (1, "/a/b~1c/1", "number", "2.5"), (1, "/a/b~1c/2", "string", "1"), (1, "/a/b~1c/3", "boolean", "true"), (1, "/a/b~1c/4", "null", ""), (1, "/a/b~1c/5", "object", ""), (1, "/a/b~1c/6", "array", ""),
        (1, "/a/~0", "string", "x"), (1, "/again", "integer", "1"), (2, "", "array", ""), (3, "", "string", "text"), (4, "/deep" + "/k/0" * 6, "string", "leaf"), (5, "/big", "number", "12345678901234567890"), (5, "/e", "number", "1.0E300"), (5, "/neg", "integer", "-7"), (6, "", "malformed", ""),
    ]
    assert got == sorted(want)


def test_differences(spark):
    def table(doc):
        return facts.flat(spark.createDataFrame([(1, json.dumps(doc))], "k long, doc string"), ["k"], "doc")

    a, b = table({"v": {"x": 1, "y": "2", "z": None}, "list": [1, 2], "gone": {}}), table({"v": {"x": "1", "y": "3", "z": None}, "list": [1, 2, 3], "new": False})
    assert {(r.path, r.difference) for r in facts.differences(a, b, ["k"]).collect()} == {("/v/x", "type"), ("/v/y", "value"), ("/list/2", "unexpected"), ("/gone", "missing"), ("/new", "unexpected")}
    assert facts.differences(a, a, ["k"]).count() == 0


def test_differences_of_a_row(spark):
    """As by the join of both sides; nothing is shuffled or written for it."""
    deep = {"a": [[{"b": {"c": [[1, {}]]}}]]}
    docs = [({"v": {"x": 1, "y": "2", "z": None}, "list": [1, 2], "gone": {}}, {"v": {"x": "1", "y": "3", "z": None}, "list": [1, 2, 3], "new": False}), (deep, {"a": [[{"b": {"c": [[2, []]]}}]]}), ({"q": 'a"}{[\\'}, {"q": 'a"}{[\\', "": [None]}), ([], {})]
    rows = [(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(docs)] + [(10, None, "1"), (11, "1", None), (12, "{bad", "[1]"), (13, None, None), (14, "{bad", "[bad")]
    df = spark.createDataFrame(rows, "k long, l string, r string")
    got = facts.row_differences(df, ["k"], "l", "r")
    want = facts.differences(facts.flat(df, ["k"], "l"), facts.flat(df, ["k"], "r"), ["k"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 13
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_typed_fields(spark):
    df = spark.createDataFrame([('{"a": {"b": "7", "c": 3}}',), ('{"a": 1}',), ("{",)], "doc string")
    got = facts.typed(df, "doc", {"b": ("$.a.b", "string"), "c": ("$.a.c", "int")})
    assert [(r.b, r.c) for r in got.collect()] == [("7", 3), (None, None), (None, None)]
