"""Quality by hierarchical empirical Bayes: a document classifier and the site a document is from.

The classifier is a logistic regression on the shape of the whole text (classes of neighbouring
characters, lengths, repeated lines), trained in numpy on a bounded sample of labelled rows.
Sites are levels of columns, a host and paths within it. Labelled rows are counted per site in
one aggregate for each level; a level's strength (pseudo counts) is estimated from how much its
sites differ (method of moments). A site's rate is shrunk toward its parent's, the host's toward
the global rate. The score joins both: logit = evidence of the text + logit of the site's rate.

Null sites are sites. Sites without labels have their parent's rate. Null and empty texts have
the evidence of an empty text. Labels other than 0 and 1 are not counted; without labels all
scores are 0.5. Repeated rows are separate. Empty tables give no rows; other columns are passed
on, those named like results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import checkpoint, crc_mod_column, documents, size_checked, slices, text_bytes, unused

#: Labelled rows to learn from, about, by label.
SAMPLE = (2000, 2000)
SLICE = 1 << 20
KEEP = 0.5
#: Sites that are broadcast at most; the documents are shuffled by more.
FEW_SITES = 500_000
#: Classes of bytes: lower, upper, digit, non-ASCII, blank, line break, and 26 of punctuation by place.
_CLASS = np.array([5 if c in (10, 13) else 4 if c in (9, 11, 12, 32) else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c >= 128 else 6 + c % 26 for c in range(256)], np.int64)
FEATURES = 1024 + 5


def features(column: pa.Array) -> np.ndarray:
    """Roots of the shares of neighbouring byte classes; length, line and word figures; float32."""
    data, offsets = text_bytes(column)
    n = len(column)
    out = np.zeros((n, FEATURES), np.float32)
    lo, hi = int(offsets[0]), int(offsets[-1])
    sizes = np.diff(offsets)
    if hi > lo:
        c = _CLASS[data[lo:hi]]
        row = np.repeat(np.arange(n), sizes)
        same = row[:-1] == row[1:]
        pairs = np.bincount(row[:-1][same] * 1024 + c[:-1][same] * 32 + c[1:][same], minlength=n * 1024).reshape(n, 1024)
        out[:, :1024] = np.sqrt(pairs / np.maximum(1, sizes - 1)[:, None])
    for k in range(n):
        text = data[offsets[k] : offsets[k + 1]].tobytes()
        lines = [x for x in text.split(b"\n") if x]
        words = text.split()
        out[k, 1024:] = (np.log1p(sizes[k]) / 10, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / max(1, len(words)), np.log1p(len(lines)) / 10, len(text) / max(1, len(words)) / 10)
    return out


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: float


def train(x: np.ndarray, y: np.ndarray, steps: int = 400) -> Classifier:
    """Both classes weigh the same, so that the logit is evidence and not a prior."""
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(FEATURES, np.float32), 0.0)
    share = (0.5 / np.bincount(y, minlength=2)[y]).astype(np.float32)
    w, m, s = (np.zeros(FEATURES + 1, np.float32) for _ in range(3))
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * share).astype(np.float32) + 1e-5 * w
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        w -= 0.2 * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return Classifier(w[:-1], float(w[-1]))


def fit(labelled: DataFrame, label: str) -> Classifier:
    """labelled: doc_id, text, label 0 or 1. Trains on about SAMPLE[y] rows of label y, of a repeated
    doc_id on that with the smallest hash of its text."""
    from plumbline.llm.toxicity import chosen, one_text

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column(label), pa.array([r.tobytes() for r in features(part.column("text"))], pa.binary())], names=["y", "x"])

    few = one_text(chosen(labelled.select("doc_id", "text", label), label, SAMPLE), "doc_id", label).select("text", F.col(label).cast("int").alias(label))
    found = sorted((r.y, bytes(r.x)) for r in few.mapInArrow(rows, "y int, x binary").collect())
    return train(np.stack([np.frombuffer(b, np.float32) for _, b in found]) if found else np.zeros((0, FEATURES), np.float32), np.array([y for y, _ in found], np.int64))


def site(column: str) -> Column:
    """A site's key; null is a site of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))


def strength(groups: DataFrame, parent: Column) -> float:
    """Pseudo counts of a level by the method of moments. groups: n, k and the parent's rate."""
    r = groups.select("n", (F.col("n") * F.pow(F.col("k") / F.col("n") - parent, F.lit(2))).alias("s"), (parent * (1 - parent)).alias("v")).agg(F.count(F.lit(1)), F.sum("n"), F.sum("s"), F.sum(F.col("n") * F.col("v")), F.sum(F.pow("n", F.lit(2)))).first()
    groups_n, total, spread, inside, squares = (float(x or 0) for x in r)
    if groups_n < 2 or total <= 0 or inside <= 0:
        return 1.0
    v = inside / total
    between = (spread - (groups_n - 1) * v) / max(1e-9, total - squares / total)
    return float(min(1e6, max(1.0, v / between - 1))) if between > 0 else 1e6


def site_rates(labelled: DataFrame, label: str, levels: list[str]) -> tuple[float, list[DataFrame]]:
    """The global rate, and for each level its sites' keys with rate_1, rate_2, ..."""
    total, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    rate = (ones + 1) / (total + 2)
    keys = [f"_site_{k + 1}" for k in range(len(levels))]
    base = labelled.select(*(site(c).alias(k) for c, k in zip(levels, keys, strict=True)), F.col(label).cast("long").alias("_y"))
    finest = checkpoint(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("k")))
    out: list[DataFrame] = []
    for depth in range(1, len(keys) + 1):
        groups = finest.groupBy(*keys[:depth]).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        parent = F.lit(rate)
        if out:
            groups, parent = groups.join(out[-1], keys[: depth - 1]), F.col(f"rate_{depth - 1}")
        m = strength(groups, parent)
        out.append(checkpoint(groups.select(*keys[:depth], ((F.col("k") + m * parent) / (F.col("n") + m)).alias(f"rate_{depth}"))))
    return rate, out


def score(docs: DataFrame, model: Classifier, rate: float, sites: list[DataFrame], levels: list[str]) -> DataFrame:
    """docs with text_score, site_rate and quality_score, 0 to 1 each."""
    docs = docs.drop("text_score", "site_rate", "quality_score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    z, *keys = unused(docs, "_z", *(f"_site_{k + 1}" for k in range(len(levels))))
    rates = unused(docs, *(f"rate_{k + 1}" for k in range(len(levels))))

    def scored(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = features(part.column("text")) @ held.value.weights + held.value.bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(found, -30, 30).astype(float))], names=[*part.schema.names, z])

    out = docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(z, T.DoubleType())]))
    out = out.withColumns({k: site(c) for c, k in zip(levels, keys, strict=True)})
    for depth, table in enumerate(sites, 1):
        table = table.toDF(*keys[:depth], rates[depth - 1])
        out = out.join(size_checked(table, table.count(), FEW_SITES), keys[:depth], "left")
    p = F.coalesce(*map(F.col, reversed(rates)), F.lit(rate))
    join = lambda x: 1 / (1 + F.exp(-x))
    return out.select(*docs.columns, join(F.col(z)).alias("text_score"), p.alias("site_rate"), join(F.col(z) + F.log(p / (1 - p))).alias("quality_score"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The two levels of a URL: its host and the first part of its path."""
    return F.lower(F.parse_url(url, F.lit("HOST"))), F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/"), 2)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Scores all documents: source is the host, lang the path. Rows whose crc32(doc_id) mod 5 is
    0 are held out of training and of the sites' counts."""
    from plumbline.sources import load

    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    labels = load(spark, sf_dir, "labels").filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").filter(crc_mod_column(F.col("doc_id"), 5) != 0)
    counted = docs.select("doc_id", "source", "lang").join(labels, "doc_id")
    rate, sites = site_rates(counted, "quality", ["source", "lang"])
    from plumbline.llm.toxicity import chosen

    few = chosen(labels.distinct(), "quality", SAMPLE)  # its size is bounded by SAMPLE
    model = fit(docs.join(F.broadcast(few), "doc_id"), "quality")
    found = score(docs, model, rate, sites, ["source", "lang"])
    return found.select("doc_id", (crc_mod_column(F.col("doc_id"), 5) == 0).alias("held_out"), "text_score", "site_rate", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP).cast("int").alias("predicted"), (F.col("quality_score") >= KEEP).alias("kept"))
