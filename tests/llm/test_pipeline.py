import glob
import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import pytest
from test_mixing import fill

import corpus_pipeline as pipeline
from plumbline.llm import sharding
from plumbline.llm.common import shared_folder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("data"))
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def test_stages_as_by_brute_force(spark, small):
    from test_decontam import brute as leaks
    from test_jaccard import brute as near

    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "1234 %%", None, None, 7), (902, docs.first().text, "en", "s", 9)], COLUMNS)
    docs = docs.unionByName(extra)
    out = pipeline.language_id(spark, docs, small)
    kept = {r.doc_id: r for r in out.collect()}
    assert {r.doc_id for r in docs.collect()} - set(kept) == {900, 901} and out.columns == docs.columns

    out2 = pipeline.near_duplicates(spark, out, small)
    rows = [(r.doc_id, r.text) for r in kept.values()]
    want = {eval(x)[2] for x in near(rows, pipeline.WIDTH, pipeline.PERCENT)}
    kept2 = {r.doc_id: r for r in out2.collect()}
    assert set(kept2) == want and out2.columns == docs.columns

    out3 = pipeline.decontamination(spark, out2, small)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r.doc_id for r in out3.collect()} == {i for i, r in kept2.items() if not leaks(r.text, items)[1]}

    out4 = pipeline.mixture(spark, out3, small)
    rows3 = out3.collect()
    want = mixed([(r.doc_id, r.text, r.source) for r in rows3])
    assert out4.columns == docs.columns and Counter(r.doc_id for r in out4.collect()) == +Counter(want)

    out5 = pipeline.shards(spark, out4, small).collect()
    total = sum(len((r.text or "").encode()) for r in out5)
    assert Counter(r.doc_id for r in out5) == +Counter(want) and total < sharding.MAX_SHARD_BYTES and {r.shard for r in out5} == {""}


def mixed(rows):
    """{doc_id: times}: each source's documents by the MD5 of id and size, again and again up to its target."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by["~" if s is None else "=" + s].append((hashlib.md5(f"{i}:{size(t)}".encode()).hexdigest(), i, size(t)))
    sizes = {s: sum(n for *_, n in v) for s, v in by.items()}
    target = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(by))}, sum(sizes.values()))
    out = {}
    for s, v in by.items():
        walk = sorted(v)
        goal = math.floor(target[s] + 0.5)
        for _, i, n in walk:
            out[i] = 0
        at, taken = 0, Counter()
        while at < goal:
            for _, i, n in walk:
                taken[i] += max(0, min(n, goal - at))
                at += n
        for _, i, n in walk:
            out[i] = math.floor(taken[i] / n + 0.5) if n else 0
    return out


def test_run(spark, small):
    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*"))
    got = pipeline.run(spark, small)
    (made,) = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*")) - before
    assert os.listdir(made) == ["4-shards"]  # a stage goes when the next one is written
    assert got.count() > 100 and {"doc_id", "text", "shard"} <= set(got.columns)


def test_empty(spark, small):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
