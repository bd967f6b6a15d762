import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrow as A
from plumbline.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'binary' if isinstance(values[n], bytes) else 'string'}" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("value,want", [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (0.000001, "0.000001"), (1e-7, "1e-7"), (123.456, "123.456"), (-5e-324, "-5e-324"), (1.5e300, "1.5e+300"), (333333333.3333333, "333333333.3333333")])
def test_numbers_of_canonical_json(value, want):
    assert A.number(value) == want


def test_canonical_json(spark):
    assert one(spark, A.canonical_json("t"), t='{"b": [1.0, null, true], "a": {"\\u20ac": "x\\n", "c": 1e30}}') == '{"a":{"c":1e+30,"€":"x\\n"},"b":[1,null,true]}'
    assert A.jcs({"\U0001f600": 1, "דּ": 2}) == '{"\U0001f600":1,"דּ":2}'


def test_paths_nfc_and_hmac(spark):
    assert one(spark, A.resolve_target("b", "t"), b="ppt/slides/slide1.xml", t="../media/a%20b.png") == "ppt/media/a b.png"
    assert one(spark, A.resolve_target("b", "t"), b="ppt/a.xml", t="http://x/y") is None
    assert one(spark, A.resolve_target("b", "t"), b="ppt/a.xml", t="../../../x") is None
    assert one(spark, A.is_nfc("t"), t="é") is False
    assert one(spark, A.hmac_sha256(b"key")("t"), t="The quick brown fox jumps over the lazy dog") == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"


def test_ssim_and_differences():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (20, 30, 3), np.uint8)
    assert A.ssim(a, a) == pytest.approx(1.0) and A.ssim(a, a[:10]) == 0.0
    assert A.ssim(a, 255 - a) < 0.1
    assert A.amplified(np.array([[3, 250]], np.uint8), np.array([[5, 10]], np.uint8)).tolist() == [[20, 255]]


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.hard_tokens(c), t='Use #FF00aa and `x y` in "A" at 12pt') == sorted(["#FF00aa", "`x y`", '"A"', "12pt"])
    assert one(spark, T.protected_replace(c, [("cat", "dog")]), t="cat `cat` cat") == "dog `cat` dog"
    assert one(spark, T.strip_markdown(c), t="**Note**: a **bold** word ") == "a bold word"
    assert one(spark, T.fenced_blocks(c), t="a ```x\ny``` b ```z```") == ["```x\ny```", "```z```"]
    assert one(spark, T.exact_ratio(c, 8), t="12") == "1.5" and one(spark, T.exact_ratio(c, 4), t="-0") == "0"
    assert one(spark, T.parse_boolean(c), t="on") is True and one(spark, T.parse_boolean(c), t=None) is None
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, T.parse_boolean(c), t="maybe")
    assert one(spark, T.relationship_source(c), t="ppt/slides/_rels/slide1.xml.rels") == "ppt/slides/slide1.xml"
    assert one(spark, T.api_key(c), t="gl_tok_s_e_c").asDict() == {"prefix": "gl_tok", "secret": "s_e_c"}
    assert one(spark, T.field_type(c), t="datetimeFigureOut") == "datetime"
    assert one(spark, T.html_escape(c), t="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, T.strip_unicode(c), t=" x ") == "x"
    assert one(spark, T.is_uuid(c), t="00000000-0000-0000-0000-00000000000g") is False


def test_projections(spark):
    import random

    from plumbline.operators import projection as P

    docs = spark.createDataFrame([(1, '{"b": 1, "reviews": [2], "a": "é"}'), (2, "[1]"), (3, None), (4, "x")], "k long, t string")
    got = {r.k: r.d for r in docs.select("k", P.review_digest(F.col("t"), "d v1", "doc", "reviews").alias("d")).collect()}
    want = hashlib.sha256('{"doc":{"a":"é","b":1},"domain":"d v1"}'.encode()).hexdigest()
    assert got == {1: f"sha256:{want}", 2: None, 3: None, 4: None}
    drawn = spark.createDataFrame([(5,), (None,)], "s int").select(P.jitter(F.col("s"), 2.0, 0.5).alias("x")).collect()
    assert [r.x for r in drawn] == [random.Random(5).uniform(-2, 2) + 0.5, None]
    frozen = P.freeze(spark.createDataFrame([('{"l": [{"name": "n", "f": "1"}, {"name": "n", "f": "2"}]}',), ('{"l": [{"name": "n", "f": "1"}]}',), ("x",)], "t string"), "t", {}, {"one": ("$.l", "n", "f")})
    assert [(r.one, r.problem) for r in frozen.collect()] == [(None, "one"), ("1", None), (None, "one")]
