import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.mixing import mix


def fill(sizes, weights, total):
    """Water filling by repeated sharing."""
    out, full = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        w = sum(weights[s] for s in free)
        out = {s: 3 * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = [s for s in free if out[s] > 3 * sizes[s]]
        if not over:
            return out
        full.update(over)


def test_targets_and_taken(spark, docs, prose):
    rows = [(k, prose(5 + k * 7 % 90, k), None, f"s{k % 3}") for k in range(900)]
    rows += [(5000 + k, prose(40, k), None, "tiny") for k in range(4)] + [(6000, None, None, None), (6001, "", None, None), (6002, "a b c", None, None), (6002, "a b c", None, None), (None, "x y", None, "s1")]
    got = mix(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes["~" if s is None else "=" + s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    total = sum(sizes.values())
    want, taken = fill(sizes, weights, total), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r._src]) and r.source_size == sizes[r._src]
        assert 0 <= r.taken <= 3 * r.size
        taken[r._src] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 5
    again = mix(docs(rows).repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_sources_smaller_than_a_block(spark, docs, prose):
    rows = [(k, prose(100, k), None, f"s{k % 2}") for k in range(400)]
    rows += [(1000 + 10 * s + k, prose(1 + s % 5, s), None, f"t{s:02}") for s in range(30) for k in range(2)]
    got = mix(docs(rows), slots=64).collect()  # a block holds over 600 words, a small source 2 to 10
    taken, target = defaultdict(int), {r._src: r.target for r in got}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r._src] += r.taken
    assert len(target) == 32
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5, s


@pytest.mark.parametrize("slots", [8, 200, 1 << 18])
def test_taken_as_by_brute_force(spark, docs, prose, slots):
    """Sources of 1, 10 and 1000 words and more: every word of a source's stream is taken goal / size times, the first ones once more."""
    rows = [(k, prose(1 + k % 37, k), None, "big") for k in range(300)] + [(1000, "a", None, "one"), (1001, "a b c d e f g h i j", None, "ten"), (1002, "", None, "zero")]
    rows += [(2000 + k, prose(10, k), None, "thousand") for k in range(100)] + [(3000 + k, "x y", None, None) for k in range(3)]
    table = docs(rows)
    got = {r.doc_id: r for r in mix(table, slots=slots).collect()}
    streams = defaultdict(list)
    for r in sorted(mixing.sized(table).collect(), key=lambda r: r._at):
        streams[r._src].append((r.doc_id, r.size))
    for ids in streams.values():
        size = sum(n for _, n in ids)
        goal, at = int(got[ids[0][0]].target + 0.5), 0
        for i, n in ids:
            want = sum(goal // size + (w < goal % size) for w in range(at, at + n))
            assert got[i].taken == want, (i, goal, size)
            at += n


def test_shares_are_met_in_every_stretch_of_the_schedule(spark):
    sources = spark.createDataFrame([(f"s{k}", 40_000 // (k + 1), 10_000.0 * (1 + k % 3)) for k in range(6)] + [("tiny", 4, 3.0)], "_src string, source_size long, target double")
    plan = mixing.planned(sources, 20)
    need = {r._src: r.slots for r in plan.collect()}
    slots = sorted((r.slot, r._src, r["rank"]) for r in mixing.schedule(plan).collect())
    total, seen = len(slots), defaultdict(int)
    assert total == sum(need.values()) and need["tiny"] == 3
    for place, (_, src, rank) in enumerate(slots, 1):
        assert rank == seen[src]
        seen[src] += 1
        if place % 100 == 0:
            assert all(abs(seen[s] - place * n / total) < 8 for s, n in need.items())


def test_no_words(spark, docs):
    assert mix(docs([])).count() == 0
    assert [r.taken for r in mix(docs([(1, None), (2, " ")])).collect()] == [0, 0]


def test_no_python_in_the_plan(spark, docs):
    plan = mix(docs([(1, "a b", None, "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
    assert mix(docs([(1, "a b", None, "s")])).agg(F.sum("taken")).first()[0] == 2
