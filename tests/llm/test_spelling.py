import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import spelling


def edits(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(words: dict[str, int], ratio: int = 10):
    near = {w: [x for x in words if edits(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w], form[w] and words[form[w]], root(w)) for w, n in words.items())


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words_of(rows):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def variants(rng, n, letters="abcé"):
    out = Counter()
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 11)))
        out[w] += rng.choice([2, 5, 60, 900])
        for _ in range(3):
            k = rng.randrange(len(w))
            out[rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])] += rng.choice([2, 3, 30])
    return {w: n for w, n in out.items() if len(w) >= 7}


@pytest.mark.parametrize("seed,letters", [(1, "abcé"), (2, "ab"), (3, "abcdefghij")])
def test_group_as_by_brute_force(spark, seed, letters):
    words = variants(random.Random(seed), 120, letters)
    assert got(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=7, max_size=12), st.integers(0, 11), st.sampled_from("abé"), st.sampled_from("idr"), st.lists(st.integers(0, 3), min_size=9, max_size=9))
def test_near_words_meet(word, k, letter, kind, counts):
    """Whatever the order of bigrams, one edit leaves a key in common."""
    k %= len(word)
    other = {"i": word[:k] + letter + word[k:], "d": word[:k] + word[k + 1 :], "r": word[:k] + letter + word[k + 1 :]}[kind]
    places = [0] * (1 << spelling.ORDER_BITS)
    for n, g in zip(counts, (x + y for x in "abé" for y in "abé"), strict=True):
        places[spelling.bucket_of(g)] = n
    if other == word:
        return
    short, long = sorted((word, other), key=len)
    keys = lambda w, kind: {key for longer, key in spelling.keys_of(w, places) if longer == kind}
    assert keys(short, len(short) < len(long)) & keys(long, False)


def test_words_of_texts(spark, docs, odd):
    rng = random.Random(5)
    names = list(variants(rng, 40))
    rows = [(k, " ".join(rng.choice(names).upper() if rng.random() < 0.3 else rng.choice(names) for _ in range(200)) + " Ärgerlich×× 12 short") for k in range(20)]
    rows += [(None, "nullword nullword Nullwort"), (None, None), (3, ""), (7, "y" * 100_000 + " " + "y" * 100_000)]
    rows += [(i, t) for i, t, *_ in odd]
    table = docs(rows).withColumnsRenamed({"shard": "word", "n_words": "run", "size": "key"}).withColumn("n", F.lit("x"))
    found = spelling.runs(table, 7).select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    words = words_of(rows)
    assert len(words) > 50 and got(spelling.group(spelling.counted(found))) == brute(words)


def test_chains_and_ties(spark):
    words = {"abcdefgh": 2, "abcdefgx": 20, "abcdefyx": 200, "abcdezyx": 2000, "qqqqqqqq": 2, "qqqqqqqa": 50, "qqqqqqqb": 50, "lonelyword": 9}
    rows = {r[0]: r for r in got(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert rows["abcdefgh"][3:] == ("abcdefgx", 20, "abcdezyx") and rows["qqqqqqqq"][3] == "qqqqqqqa" and rows["lonelyword"][2:] == (0, None, None, "lonelyword")


def test_one_bucket_is_not_all_words_with_a_common_bigram(spark):
    """Words that share their beginning and their length meet by their ends only where the shared bigram is there."""
    rng = random.Random(9)
    words = {"commonstart" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)): 2 for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    places, keys = spelling.places(df), Counter()
    for w in words:
        keys.update({k for longer, k in spelling.keys_of(w, places) if not longer})
    assert max(keys.values()) < 40


def test_empty_and_too_short(spark):
    assert spelling.group(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.counted(spark.createDataFrame([], "word string"), least_length=3)
