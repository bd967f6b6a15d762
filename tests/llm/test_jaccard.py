import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import common, jaccard
from plumbline.llm.components import components
from plumbline.llm.common import LOWER_BYTES
from plumbline.llm.shingles import shingle_sets


def sets(text, width):
    w = (text or "").encode().translate(LOWER_BYTES).split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    s = [sets(t, width) for _, t, *_ in rows]
    near = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                near[a].add(b)
                near[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.append((rows[a][0], len(s[a]), min((rows[x][0] for x in seen if rows[x][0] is not None), default=None), len(near[a])))
    return sorted(map(str, out))


def found(spark, docs, rows, width, percent):
    got = jaccard.join(docs(rows), width, percent).collect()
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in got)


def edited(text, k, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("width,percent,few,block", [(3, 90, 48, 1024), (5, 80, 48, 5), (3, 90, 3, 7), (5, 80, 4, 1024)])
def test_components_and_links_as_by_brute_force(spark, docs, prose, odd, monkeypatch, width, percent, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)  # also drives the way for frequent shingles
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(common, "HOT", 4)
    rows = [*odd, (11, "A b"), (12, "a B")]
    for g in range(4):
        base = prose(120 + 40 * g, 50 + g, 5000)
        rows += [(1000 * (g + 1) + k, edited(base, k % 7, k)) for k in range(25)]
    rows += [(9000 + k, prose(60, k, 5000) + " " + prose(55, 99)) for k in range(20)]
    rows += [(9500 + k, f"copy of one text {'z ' * 30}") for k in range(12)]
    assert found(spark, docs, rows, width, percent) == brute(rows, width, percent)


def test_rows_without_or_with_a_repeated_id(spark, docs, prose):
    """Links pass through rows without an id; a repeated id links nothing."""
    w = prose(100, 3, 5000).split()
    chain = [" ".join(w[:k] + [f"n{j}" for j in range(k, 5)] + w[5:]) for k in (5, 3, 1)]  # neighbours only are linked
    rows = [(20, chain[0]), (None, chain[1]), (10, chain[2]), (None, chain[1].upper()), (30, "one text"), (30, "another text here"), (31, "another text here"), (30, "one text")]
    rows += [(None, "no id at all"), (None, "no id at all"), (30, None), (5, prose(40, 8)), (5, prose(40, 9))]
    assert found(spark, docs, rows, 3, 90) == brute(rows, 3, 90)
    got = jaccard.keep_one(docs(rows), 3, 90).collect()
    left = sorted((str(r.doc_id), (r.text or "").lower()) for r in got)
    assert left == sorted([("10", chain[2]), ("30", "one text"), ("30", "another text here"), ("None", "no id at all"), ("30", ""), ("5", prose(40, 8)), ("5", prose(40, 9))])
    assert got[0].shard == "x" and got[0].n_words == "y"


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


@pytest.mark.parametrize("n", [16, 64, 128, 1024])
def test_words_that_polynomials_confuse(spark, docs, n):
    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"{one} {two} x {two} {one} x {one}"), (4, f"{two} x x"), (5, f"{one} x x")]
    assert found(spark, docs, rows, 3, 90) == brute(rows, 3, 90)


def group_of(m, prose):
    """m near copies of one text, each with one word changed."""
    w = prose(120, 7, 5000).split()
    return [(k, " ".join([*w[: k % 100 + 10], f"own{k}", *w[k % 100 + 11 :]])) for k in range(m)]


@pytest.mark.parametrize("m", [60, 240])
def test_comparisons_grow_with_a_group_not_with_its_square(spark, prose, monkeypatch, m):
    """Rows that leave the runs of shingles, and pairs that are compared, for each document of one group."""
    compared, whole = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *more: compared.append(pairs.count()) or whole(pairs, *more))
    docs = spark.createDataFrame(group_of(m, prose), "node long, text string")
    found = jaccard.linked(docs, 3, 90)
    assert found.roots.select("root").distinct().count() == 1 and found.roots.count() == m - 1
    assert sum(compared) <= 20 * m


def test_as_much_of_each_group_is_known_as_common_at_every_size(spark, prose, monkeypatch):
    """What the sample doesn't know of a group is counted row by row: no more for each group in a larger table."""
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 256)
    monkeypatch.setattr(jaccard, "SAMPLE_OF", 512, raising=False)
    known = []
    for groups in (40, 400):
        rows = [(12 * g + k, edited(prose(60, g, 10**6), 2, 12 * g + k)) for g in range(groups) for k in range(12)]
        known.append(len(jaccard.common_shingles(spark.createDataFrame(rows, "node long, text string"), 3)[0]) / groups)
    assert known[1] > 0.8 * known[0] > 20


def test_very_long_near_copies(spark, docs):
    text = " ".join(f"w{k * 7919 % 1_000_003}" for k in range(2_400_000))
    got = jaccard.join(docs([(1, text), (2, f"{text} more"), (3, "other words of one text")]), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


@pytest.mark.parametrize("n,m,words", [(1, 1, 5), (30, 20, 40), (200, 3, 3000), (3, 300, 60)])
def test_overlaps(n, m, words):
    rng = np.random.default_rng(n * m)
    hashes = rng.integers(0, 2**64, words, np.uint64)
    pick = lambda: np.sort(rng.choice(hashes, rng.integers(0, words), replace=False))
    one, two = [pick() for _ in range(n)], [pick() for _ in range(m)]
    want = [[len(np.intersect1d(a, b)) for b in two] for a in one]
    assert jaccard.overlaps(one, two).tolist() == want


def test_more_shingles_in_a_bin_than_16_bits_hold(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BINS", 2)
    text = " ".join(f"w{k}" for k in range(70_000))
    got = jaccard.join(docs([(1, text), (2, f"{text} more"), (3, "other words of one text")]), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 69_998, 1), (2, 69_999, 1), (3, 3, 3)]


def test_shingles_of_slices():
    import pyarrow as pa

    texts = ["a b c d", None, "", "a b", "A  B\tC\nD", "c d", " x ", "a b c d a b c d"]
    found = shingle_sets(pa.array(texts, pa.string()), 3)
    assert [len(x) for x in found] == [len(sets(t, 3)) for t in texts]
    assert found[0].tolist() == found[4].tolist()
    part = shingle_sets(pa.array(texts, pa.string()).slice(3, 3), 3)
    assert [x.tolist() for x in part] == [x.tolist() for x in found[3:6]]


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    got = dict(components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect())
    assert got == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark, docs):
    assert jaccard.join(docs([]), 3, 90).count() == 0


@pytest.mark.parametrize("few,grow", [(4, 1.25), (96, 1)])
def test_one_shared_phrase_makes_no_candidates(spark, monkeypatch, few, grow):
    """Documents of other sizes, or with one frequent shingle in common, aren't compared any further."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 0)  # the sample misses it
    phrases = [f"a{k} b c" for k in range(500)]
    first = [int(h[0]) for h in shingle_sets(pa.array(phrases), 3)]
    phrase = phrases[first.index(min(first))]  # in the prefix of every document
    rows = [(i, " ".join([phrase, *(f"w{i}x{k}" for k in range(int(40 * grow**i)))])) for i in range(12)]
    found = jaccard.linked(spark.createDataFrame(rows, "node long, text string"), 3, 90)
    assert found.often.count() == found.sets.count() == found.pairs.count() == 0
