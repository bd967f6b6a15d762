"""Columns of the input that are named like an operator's results or like columns it uses inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from plumbline.llm import decontam, exact_dedup, jaccard, language, licenses, mixing, quality, secrets, sharding, toxicity

INSIDE = ["_h", "_row", "_depth_0", "_cell_0", "_src", "_size", "_times", "_mark", "_z", "_site_1", "rate_1", "key", "node", "root", "set_key", "bytes", "digest", "mark", "keep", "size", "block", "row"]
ROWS = [(1, "some words of a text", "en", "s"), (2, None, None, None), (2, "Under the MIT license a b c d e", "de", "t"), (None, "", "en", "s")]


def run(name, docs, spark):
    items = spark.createDataFrame([(1, "some words of a text")], "item_id long, text string")
    if name == "language":
        return language.identify(docs, language.fit(docs)), ["lang_pred", "lang_score"]
    if name == "toxicity":
        return toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))), ["toxic_score"]
    if name == "quality":
        rate, sites = quality.site_rates(docs.withColumn("q", F.lit(1)), "q", ["source", "lang"])
        model = quality.fit(docs.select("doc_id", "text").withColumn("q", F.lit(1)), "q")
        return quality.score(docs, model, rate, sites, ["source", "lang"]), ["text_score", "site_rate", "quality_score"]
    if name == "secrets":
        return secrets.scan(docs, secrets.train(secrets.labelled_findings(200)), "source"), ["findings", "redacted"]
    if name == "licenses":
        return licenses.scan(docs), ["n_words", "base_places", "license_matches"]
    if name == "decontam":
        return decontam.scan(docs, items), ["n_words", "hit_spans", "hit_items"]
    if name == "decontam in blocks":
        return decontam.scan(docs, items, item_bytes=1), ["n_words", "hit_spans", "hit_items"]
    return sharding.shard(docs), ["shard", "depth", "doc_bytes", "shard_bytes", "global_depth"]


PASSING = ["language", "toxicity", "quality", "secrets", "licenses", "decontam", "decontam in blocks", "sharding"]


@pytest.mark.parametrize("name", PASSING)
def test_operators_that_pass_columns_on(spark, docs, name):
    plain = docs(ROWS, "extra string, other string, third string")
    base, own = run(name, plain, spark)
    wide = plain.select("*", *(F.lit(f"<{c}>").alias(c) for c in [*INSIDE, *own]))
    got, _ = run(name, wide, spark)
    assert sorted(got.columns) == sorted([*plain.columns, *INSIDE, *own])
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r[c] == f"<{c}>" for r in rows for c in INSIDE)
    key = lambda r: str([r.doc_id, r.text, *(r[c] for c in own)])
    assert sorted(map(key, rows)) == sorted(map(key, base.collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, tmp_path, k):
    spark.createDataFrame([(1, "not in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs([(n, f"the words of text number {n} and some more of it {'x ' * n}", "en", "s") for n in range(1, 30)] + ROWS, "extra string, other string, third string")
    names = [*INSIDE, "doc_bytes", "n_words", "lang_pred", "hit_spans", "taken", "component_id", "source_size"]
    wide = plain.select("*", *(F.lit(f"<{c}>").alias(c) for c in names))
    _, stage = pipeline.STAGES[k]
    base, got = stage(spark, plain, str(tmp_path)), stage(spark, wide, str(tmp_path))
    key = lambda r: str((r.doc_id, r.text))
    rows = got.collect()
    assert sorted(map(key, rows)) == sorted(map(key, base.collect())) and len(rows) > 20
    kept = [c for c in names if k < 4 or c != "doc_bytes"]
    assert all(r[c] == f"<{c}>" for r in rows for c in kept)


def test_operators_that_take_columns_of_their_own(spark, docs):
    plain = docs(ROWS, "extra string, other string, third string")
    wide = plain.select("*", *(F.lit("x").alias(c) for c in [*INSIDE, "n_shingles", "component_id", "n_links", "keep_id", "kept", "group_size", "old", "taken", "target", "source_size"]))
    for call in (lambda d: jaccard.join(d, 3, 90), lambda d: exact_dedup.decided(d, F.expr("doc_id = 1")), mixing.mix):
        assert sorted(map(str, call(wide).collect())) == sorted(map(str, call(plain).collect()))
