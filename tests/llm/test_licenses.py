"""Labels and scores of op8_licenses, and empty tables, against plain Python over the same rules."""

import re

import numpy as np

from plumbline.llm import licenses, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    """(n_words, n_base, first, last, base labels, labels, score): every rule on every text, every pair of intervals compared."""
    words = WORD.findall(lower(text))
    base = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line = f" {' '.join(words)} "
    met = [(-r.priority, m.start() - m.end(), m.start(), r.order, m.end(), r) for r in licenses.rules() for m in r.pattern.finditer(line)]
    taken = []
    for _, _, start, _, end, rule in sorted(met, key=lambda x: x[:4]):
        if not any(a <= start and end <= b for a, b, _ in taken):
            taken.append((start, end, rule))
    missed = 1 - licenses.BASE_WEIGHT if base else 1.0
    for *_, rule in taken:
        missed *= 1 - rule.weight
    labels = {label for _, label in base} | {rule.label for *_, rule in taken}
    places = [i for i, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(1 - missed, 6)


def test_labels_and_scores_as_by_brute_force(spark, docs, odd, tmp_path):
    told = [f"released under the {name}" for name in ("MIT License", "Apache License, Version 2.0", "GNU General Public License v3", "BSD 3-Clause License", "Mozilla Public License 2.0")]
    more = [(k + 10_000, t) for k, t in enumerate([" ".join(told), "SPDX-License-Identifier: MIT; under the mit license. Copyright (c) 2020, all rights reserved", "cc by nc 4.0 cc by nc", "Alle Rechte vorbehalten ©2019", *told])]
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = table.unionByName(docs([*more, *((i, t) for i, t, *_ in odd)]).select("doc_id", "text"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(str((r.doc_id, *brute(r.text))) for r in table.collect())
    rows = licenses.op8_licenses(spark, str(tmp_path)).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in rows)
    assert got == want and sum(bool(r.labels) for r in rows) > 8 and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark, docs):
    assert licenses.scan(docs([])).count() == 0
    sites = quality.site_rates(docs([]).withColumn("q", quality.F.lit(1)), "q", ["source", "lang"])
    model = quality.train(np.zeros((0, quality.FEATURES)), np.zeros(0, int))
    assert quality.score(docs([]), model, *sites, ["source", "lang"]).count() == 0
    assert quality.score(docs([(1, "a text")]), model, *sites, ["source", "lang"]).count() == 1
