import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, exact_dedup
from plumbline.llm.exact_dedup import decided, dedup, digested, screen, snapshot
from plumbline.llm.fuse import FuseFilter


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
    f = FuseFilter.build(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**64, 20_000, np.uint64)).mean() < 0.01


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


ROWS = [*((20 + k, f"Text {k % 7} Ä") for k in range(40)), *((100 + k, "text 0 ä") for k in range(5)), (500, "same row"), (500, "same row"), (500, "SAME ROW"), (501, "same row"), (None, "no id"), (None, "No id"), (None, "no ID")]


@pytest.mark.parametrize("split", ["doc_id % 3 = 0", "false", "true", "length(text) % 2 = 0", "text like 'T%' or text = 'No id'"])
@pytest.mark.parametrize("hot", [3, 10_000])
def test_rows_as_by_brute_force(spark, docs, odd, monkeypatch, split, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = [*odd, *ROWS]
    got = decided(docs(rows).withColumnsRenamed({"size": "digest", "n_words": "old", "shard": "mark"}), F.expr(split)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (ids, max((i for i in ids if i is not None), default=None)) for t, ids in groups.items()}
    assert sorted(map(str, ((r.doc_id, bytes(r.digest).hex()) for r in got))) == sorted(map(str, ((i, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows)))
    for r in got:
        ids, keep = want[bytes(r.digest).hex()]
        assert (r.keep_id, r.group_size) == (keep, len(ids)) and (not r.kept or r.doc_id == keep)
    kept = [bytes(r.digest).hex() for r in got if r.kept]
    assert sorted(kept) == sorted(want)  # one row of each group


def test_screen_lets_all_known_digests_pass(spark, docs):
    df = docs([(k, f"t{k % 50}") for k in range(200)])
    passed = screen(digested(df).select("digest").distinct(), 200, snapshot(df.filter("doc_id < 20")))
    assert passed.distinct().count() >= 20


def test_only_what_the_filters_let_pass_brings_its_text(spark, docs, monkeypatch):
    """Texts that are new meet no bucket: with a filter that lets nothing pass, nothing is found to be the same."""
    asked = []
    whole = exact_dedup.bucketed

    def bucketed(docs, digests, n):
        out = whole(docs, digests, n)
        asked.append((n, out.count()))
        return out

    monkeypatch.setattr(exact_dedup, "bucketed", bucketed)
    df = docs([(k, f"t{k}") for k in range(400)] + [(k, f"T{k % 10}") for k in range(400, 440)])
    assert decided(df, F.expr("doc_id < 300")).filter("kept").count() == 400
    (n, new), (_, old) = asked
    assert 10 <= new == n < 20 and 10 <= old < 20  # ten repeats and about 1 in 256 of 100 new texts
    monkeypatch.setattr(exact_dedup, "screen", lambda digests, rows, snap: digests.limit(0))
    nothing = dedup(df.filter("doc_id >= 300"), snapshot(df.filter("doc_id < 300")))
    assert nothing.filter("same").count() == 0


def test_only_digests_that_pass_meet_the_snapshot(spark, docs, monkeypatch):
    """The groups that come out of the join with the snapshot: as many as digests that passed and are there, whatever the sizes."""
    df = docs([(k, f"t{k}") for k in range(400)] + [(k, f"T{k % 10}") for k in range(400, 440)])
    snap = snapshot(df.filter("doc_id < 300"))
    groups = dedup(df.filter("doc_id >= 300"), snap)
    assert groups.filter("old_n is not null and n is not null").count() == 10 and groups.count() == 10  # of 400 digests
    seen = []
    monkeypatch.setattr(exact_dedup, "screen", lambda digests, rows, snap: seen.append(digests.count()) or digests.limit(0))
    groups = dedup(df.filter("doc_id >= 300"), snap)
    assert seen == [110] and groups.filter("old_n is not null and n is not null").count() == 0
    assert sorted(r.n for r in groups.collect()) == [4] * 10  # duplicates within the batch are grouped apart


@pytest.mark.parametrize("few", [0, 500_000])
def test_many_groups_are_looked_up_by_shuffle(spark, docs, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "FEW_DIGESTS", few)
    got = decided(docs([(k, f"t{k % 30}") for k in range(90)]), F.expr("doc_id < 40")).collect()
    assert {(r.doc_id % 30, r.keep_id, r.group_size) for r in got} == {(k, 60 + k, 3) for k in range(30)} and sum(r.kept for r in got) == 30


def test_equal_digests_of_other_bytes_are_not_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digested", lambda docs: docs.withColumn("bytes", F.lower("text")).withColumn("digest", F.lit(b"0" * 32)))
    got = decided(docs([(1, "a"), (2, "b"), (3, "b")]), F.expr("doc_id = 1")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 1, True), (2, 3, 2, False), (3, 3, 2, True)]


def test_empty(spark, docs):
    none = docs([])
    assert dedup(none, snapshot(none)).count() == 0 and decided(none, F.lit(True)).count() == 0
