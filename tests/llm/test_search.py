import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, top=50):
    docs = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in rows) if t]
    n, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in q if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(str(item), k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r["item"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def corpus(prose):
    rows = [(k, prose(random.Random(k).randrange(1, 120), k, 90)) for k in range(300)]
    return rows + [(k, rows[5][1]) for k in range(900, 980)]  # ties beyond the top


@pytest.fixture()
def items(spark, prose):
    rows = [(1, prose(30, 5000, 90)), (2, "w1 W1 w2"), (3, prose(3, 5, 90)), (4, None), (None, "w3"), (5, "%%%"), (6, "nowhere found"), (2, "w7"), (7, "Ñ ñ ß w4")]
    return rows, spark.createDataFrame(rows, "item_id int, text string").withColumn("item", F.lit("x"))


@pytest.mark.parametrize("shard,block", [(10**6, 10**6), (40, 10**6), (40, 20)])
def test_ranks_as_by_brute_force(spark, docs, odd, prose, items, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(search, "SAMPLE_DOCS", 64)
    rows = corpus(prose) + [(i, t) for i, t, *_ in odd] + [(2**62 + 1, "w1 w2"), (2**62, "w2 w1")]
    table = docs(rows).withColumnsRenamed({"shard": "terms", "n_words": "n", "size": "leaf"})
    assert got(search.search(table, items[1], block_terms=block)) == brute(rows, items[0])


def test_few_shards_are_visited_and_none_too_few(spark, docs, monkeypatch):
    """Topics of their own words: a query of one topic stops before the shards of others."""
    monkeypatch.setattr(search, "DEPTH", 4)
    monkeypatch.setattr(search, "FIRST", 2)
    rng = random.Random(1)
    rows = [(k, " ".join(f"t{k % 16}w{rng.randrange(12)}" for _ in range(40)) + " common") for k in range(960)]
    asked = [(t, " ".join(f"t{t}w{w}" for w in range(6)) + " common") for t in range(16)]
    seen = []
    whole = search.visited

    def visited(held, block, visits, n, top):
        seen.append(n)
        return whole(held, block, visits, n, top)

    monkeypatch.setattr(search, "visited", visited)
    assert got(search.search(docs(rows), spark.createDataFrame(asked, "item_id int, text string"), top=20)) == brute(rows, asked, 20)
    assert sum(seen) < 16 * 16 / 2  # of 16 queries x 16 leaves


def test_bisection_keeps_topics_together():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 200, 30) + 1000 * (k % 4)) for k in range(400)]
    cuts = search.bisect(rows, depth=2)
    leaves = [{search.leaf_of(cuts, rows[k]) for k in range(topic, 400, 4)} for topic in range(4)]
    assert all(len(x) == 1 for x in leaves) and len(set.union(*leaves)) == 4


def test_bounds_hold():
    rng = np.random.default_rng(4)
    import pandas as pd

    part = pd.DataFrame({"unknown": [False] * 50, "doc_id": range(50), "n": rng.integers(1, 90, 50), "terms": [np.unique(rng.integers(0, 30, 9)) for _ in range(50)]})
    part["tfs"] = [rng.integers(1, 5, len(t)) for t in part["terms"]]
    shard = search.Shard(search.built((0,), part).iloc[0].to_dict(), 50, int(part["n"].sum()))
    weights = rng.integers(0, 4000, 30)
    for _ in range(50):
        q = np.unique(rng.integers(0, 30, 6))
        best = shard.best(q, weights, 5, 1)
        assert not best or best[0][0] <= shard.bound(q, weights)


def test_empty(spark, docs, items):
    assert search.search(docs([]), items[1]).count() == 0
    assert search.search(docs([(1, "w1"), (2, None)]), items[1].limit(0)).count() == 0
    assert search.search(docs([(1, None), (2, " ")]), items[1]).count() == 0
