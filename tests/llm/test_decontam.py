import hashlib
import re

from pyspark.sql import functions as F

from plumbline.llm import decontam
from plumbline.llm.decontam import hits, scan, tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        v = words(body)
        m = min(width, len(v))
        for k in range(len(v) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[k : k + m]:
                    hit.update(range(i, i + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_hits_and_items_as_by_brute_force(spark, docs, prose, odd):
    items = [(k, prose(8 + k, 100 + k, 30)) for k in range(20)] + [(50, "w1 w2"), (51, ""), (52, None), (None, "w3 w4 w5"), (53, "One"), (7, prose(15, 3))]
    rows = [*odd, *((100 + k, f"{prose(40, k, 30)} {items[k % 20][1].upper()}, {prose(5, k)}") for k in range(30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = scan(docs(rows), bench, item_bytes=block).collect()
        want = sorted(map(str, (brute(t, [x for x in items if x[0] is not None]) for _, t, *_ in rows)))
        assert sorted(str((r.n_words, sum(s.end - s.start for s in r.hit_spans), list(r.hit_items))) for r in got) == want


def test_one_pass_for_a_benchmark_of_any_size(spark, docs, prose, monkeypatch):
    """With 50 times the items that executors hold as tables, texts are searched once, and few places meet the windows."""
    items = [(k, prose(60, 7000 + k, 3000)) for k in range(100)]
    rows = [(k, prose(400, k, 3000) + (" " + items[k][1] if k % 10 == 0 else "")) for k in range(100)]
    asked, places = [], []
    whole = decontam.candidates

    def candidates(marked, held, mark):
        out = whole(marked, held, mark)
        asked.append(mark)
        places.append(out.count())
        return out

    monkeypatch.setattr(decontam, "candidates", candidates)
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    got = {r.doc_id: list(r.hit_items) for r in scan(docs(rows), bench, item_bytes=size // 50).collect()}
    assert got == {k: [str(k)] if k % 10 == 0 else [] for k in range(100)}
    assert len(asked) == 1 and 510 <= places[0] < 520  # 51 windows of ten documents, of 40 000 places


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert scan(docs([]), none).count() == 0
    assert scan(docs([(1, "a b")]), none).select(F.size("hit_items")).first()[0] == 0


def test_windows_of_one_and_two_words_and_overlaps():
    found = tables([("a", "x"), ("b", "x y"), ("c", "y x y x y x y x y x y x")])
    assert hits([b"x", b"x", b"y", b"z"], found) == ([[0, 3]], ["a", "b"])
    assert hits([], found) == ([], [])


def test_query_shape(spark):
    from plumbline.llm.decontam import op1_decontam

    got = op1_decontam(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got.filter("n_items = 0").first().items_sha256 == hashlib.sha256(b"").hexdigest()
    assert got.filter("contaminated").count() > 0
