"""Properties of the parts that need no Spark, on random inputs."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from test_decontam import brute
from test_jaccard import sets

from plumbline.llm import decontam, licenses
from plumbline.llm.common import slices
from plumbline.llm.ngrams import counts
from plumbline.llm.shingles import shingle_sets
from plumbline.llm.toxicity import LENGTHS
from plumbline.llm.common import WORD_BYTES

word = st.sampled_from(["a", "b", "c", "D", "é", "x9"])
text = st.one_of(st.none(), st.lists(word, max_size=30).map(" ".join))
space = st.sampled_from([" ", "\t", "\n", "\r\n", "\x0b", "\x0c", "  "])


@settings(max_examples=150, deadline=None)
@given(text, st.lists(text, max_size=4), st.integers(1, 5))
def test_window_search(doc, items, width):
    named = list(enumerate(items))
    found = decontam.tables([(str(k), t) for k, t in named if t is not None], width)
    spans, ids = decontam.hits(decontam.words_of(doc), found)
    n, hit, want = brute(doc, [x for x in named if x[1] is not None], width)
    assert (len(decontam.words_of(doc)), sum(b - a for a, b in spans), ids) == (n, hit, want)


@settings(max_examples=100, deadline=None)
@given(st.lists(text, max_size=6), st.integers(1, 6))
def test_shingles(texts, width):
    got = shingle_sets(pa.array(texts, pa.string()), width)
    assert [len(x) for x in got] == [len(sets(t, width)) for t in texts]
    for a, x in zip(texts, got, strict=True):
        for b, y in zip(texts, got, strict=True):
            assert len(set(x.tolist()) & set(y.tolist())) == len(sets(a, width) & sets(b, width))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8), st.integers(1, 60))
def test_counts_do_not_depend_on_slices(texts, limit):
    column = pa.array(texts, pa.string())
    whole = counts(column, LENGTHS, 8, WORD_BYTES, True)
    parts = [counts(p.column("text"), LENGTHS, 8, WORD_BYTES, True) for p in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text", limit)]
    assert whole.tolist() == [r for p in parts for r in p.tolist()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc sa all rights reserved gnu gpl v3".split()), max_size=40), space)
def test_license_matches_lie_in_no_earlier_one(words, gap):
    n, base, taken = licenses.find(gap.join(words))
    assert n == len(words) and all(0 <= a < b <= n for a, b, *_ in taken)
    for k, (a, b, *_) in enumerate(taken):
        assert not any(x <= a and b <= y for x, y, *_ in taken[:k])
    for p, label in licenses.BASE:
        v = p.split()
        assert [i for i, x in base if x == label] == [i for i in range(n) if words[i : i + len(v)] == v]
