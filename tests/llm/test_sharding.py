from collections import defaultdict

from plumbline.llm.sharding import shard


def test_shards_fit_and_only_full_buckets_split(spark, docs, prose, odd):
    rows = [*odd, *((100 + k, prose(5 + k % 40, k)) for k in range(600))]
    limit = 2000
    got = shard(docs(rows), limit).collect()
    assert len(got) == len(rows)
    by, n = defaultdict(int), defaultdict(int)
    for r in got:
        by[r.shard] += r.doc_bytes
        n[r.shard] += 1
    assert all(by[r.shard] == r.shard_bytes for r in got)
    assert all(b <= limit or n[s] == 1 for s, b in by.items())
    for s in by:  # a shard's parent is over the limit, and no shard's prefix is another's
        if s and "." not in s:
            assert sum(b for x, b in by.items() if x.startswith(s[:-1])) > limit
            assert not any(x != s and x.startswith(s) for x in by)
    assert max(r.depth for r in got) == got[0].global_depth


def test_rows_with_one_id_go_to_pages(spark, docs):
    got = shard(docs([(7, "x" * 300)] * 20 + [(7, "y" * 900)]), 1000).collect()
    by = defaultdict(int)
    for r in got:
        by[r.shard] += r.doc_bytes
    assert len(got) == 21 and max(by.values()) <= 1000


def test_rows_without_an_id_are_not_one_task(spark, docs):
    """A third of all rows has no id: pages are filled within each partition of them."""
    got = shard(docs([(None, "x" * 10)] * 200 + [(k, "y" * 10) for k in range(400)]), 500).collect()
    by = defaultdict(int)
    for r in got:
        by[r.shard] += r.doc_bytes
        assert r.shard_bytes <= 500
    assert len(got) == 600 and max(by.values()) <= 500 and all(by[r.shard] == r.shard_bytes for r in got)
    assert len({r.shard.split(".")[1] for r in got if r.doc_id is None}) > 1


def test_empty_and_single(spark, docs):
    assert shard(docs([])).count() == 0
    assert shard(docs([(1, None)])).first().shard == ""
    assert shard(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString().count("Python") == 0
