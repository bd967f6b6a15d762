"""Toxicity scores from subword bags: averaged embeddings into a linear softmax.

A text is the bag of the byte 3- to 5-grams of its words (blanks mark where words begin and end;
A-Z are lowered), hashed to BUCKETS. Embeddings and softmax are trained together in numpy with
Adam; rows of the embedding shrink as a group, so that n-grams without evidence carry nothing.
Unseen spellings are scored by the n-grams they share. Stretches of clean training texts are
further clean examples, as short texts are noisier. Where 0.5 lies is learned as well: models of
each half of the training rows score the other half, and the bias moves to the best F1 of these.

Training reads about SAMPLE[y] rows of label y, chosen by the hash of the id; the three models are trained in
three tasks, and the driver gets their weights only. Scoring reads whole
texts: once trained, the model is one weight for each bucket.

Null, empty and wordless texts get the score of the bias alone, or 0 if no row is labelled.
Null labels are not learned from, contradicting labels of one id each count; of rows that repeat
a doc_id that with the smallest hash of its text is learned from. They are scored as separate rows.
Empty tables give no rows; other columns are passed on, those named like results are replaced.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_BYTES, checkpoint, crc_mod_column, documents, slices, text_bytes
from plumbline.llm.ngrams import gram_hashes

BITS, LENGTHS, DIM = 16, (3, 4, 5), 8
BUCKETS = 1 << BITS
#: Labelled rows to learn from, about, by label.
SAMPLE = (3000, 1500)
STRETCHES = 2
EPOCHS, BATCH, RATE, SHRINK = 12, 64, 0.02, 0.3
#: Texts that must share a bucket for it to be learned, and what is added to its frequency.
LEAST_TEXTS, FLOOR = 3, 1e-5
SLICE = 1 << 20


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each bucket, in the difference of the two logits
    bias: float


def chosen(labelled: DataFrame, label: str, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """About sample[y] rows of label y, by the hash of doc_id: a bounded sample."""
    n = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    keep = F.lit(False)
    for value in (0, 1):
        keep = keep | ((F.col(label) == value) & (share < sample[value] / max(1, n.get(value, 0))))
    return labelled.filter(keep)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows (with a text) of each key that with the smallest hash of its text: the same one in every run."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select(*keys, F.col("x.text").alias("text"))


def examples(rows: DataFrame, label: str) -> DataFrame:
    """half (by the hash of the text), label and text, and stretches of those labelled 0, whose half is 2 or 3."""

    def stretched(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                more = []
                for text, mark in zip(part.column("text").to_pylist(), part.column(label).to_pylist(), strict=True):
                    text = text or ""
                    seed = zlib.crc32(text.encode())
                    more.append((seed % 2, int(mark), text))
                    words = text.split(" ") if mark == 0 else ()
                    rng = random.Random(seed)
                    for _ in range(STRETCHES if len(words) > 4 else 0):
                        size = rng.randint(4, 60)
                        at = rng.randrange(max(1, len(words) - size))
                        more.append((2 + seed % 2, 0, " ".join(words[at : at + size])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in more], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["half", "label", "text"])

    return rows.select("text", F.col(label).cast("int").alias(label)).mapInArrow(stretched, "half int, label int, text string")


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams (uint32, sorted) and how often each occurs (float32)."""
    data, offsets = text_bytes(pa.array([text], pa.large_string()))
    with np.errstate(over="ignore"):
        found = [bucket for _, bucket in gram_hashes(data, offsets, LENGTHS, BITS, WORD_BYTES, True)]
    at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return at.astype(np.uint32), n.astype(np.float32)


def joint(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, seed: int = 0) -> Model:
    """Embeddings and softmax of bags (buckets, counts) with labels, trained together."""
    total = np.array([max(1.0, n.sum()) for _, n in bags], np.float32)
    texts, often = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for (at, n), t in zip(bags, total, strict=True):
        texts[at] += 1
        often[at] += n / t
    held = np.flatnonzero(texts >= LEAST_TEXTS)  # the others have no embedding
    place = np.full(BUCKETS, -1, np.int32)
    place[held] = np.arange(len(held))
    scale = (1 / np.sqrt(often[held] / len(bags) + FLOOR)).astype(np.float32)
    rows = []
    for (at, n), t in zip(bags, total, strict=True):
        k = place[at]
        rows.append((k[k >= 0], n[k >= 0] / t * scale[k[k >= 0]]))
    rng = np.random.default_rng(seed)
    params = [(rng.standard_normal((len(held), DIM)) * 0.01).astype(np.float32), (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    embed, soft, bias = params
    balance = np.sqrt(len(y) / 2 / np.maximum(1, np.bincount(y, minlength=2))).astype(np.float32)
    steps = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            at = order[k : k + BATCH]
            x = np.zeros((len(at), len(held)), np.float32)
            for j, i in enumerate(at):
                x[j, rows[i][0]] = rows[i][1]
            mean = x @ embed
            z = mean @ soft + bias
            z = np.exp(z - z.max(1, keepdims=True))
            grad = z / z.sum(1, keepdims=True)
            grad[np.arange(len(at)), y[at]] -= 1
            grad *= balance[y[at]][:, None] / len(at)
            steps += 1
            for p, m, s, g in zip(params, first, second, (x.T @ (grad @ soft.T), mean.T @ grad, grad.sum(0)), strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
            embed *= np.maximum(0, 1 - rate * SHRINK / np.maximum(1e-9, np.sqrt((embed * embed).sum(1, keepdims=True))))
    weights = np.zeros(BUCKETS, np.float32)
    weights[held] = scale * (embed @ (soft[:, 1] - soft[:, 0]))
    return Model(weights, float(bias[1] - bias[0]))


def logits(model: Model, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([(model.weights[at] * n).sum() / max(1.0, n.sum()) + model.bias for at, n in bags])


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit at which F1 is best, between two neighbouring ones."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float(z[order[k]] + z[order[min(k + 1, len(y) - 1)]]) / 2


WHOLE = -1


def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One of the three models: of all examples, or of those outside a half, which it then scores (z, y).
    Half, label and text of all examples are given. Nothing for a half that is too small to learn where to cut."""
    side, bags = key[0], [bag(text) for text in rows["text"]]
    order = sorted(range(len(bags)), key=lambda k: (rows["half"][k], rows["label"][k], bags[k][0].tobytes(), bags[k][1].tobytes()))
    half, y, bags = rows["half"].to_numpy(np.int64)[order], rows["label"].to_numpy(np.int64)[order], [bags[k] for k in order]
    mine, rest = np.flatnonzero((half % 2 != side) | (side == WHOLE)), np.flatnonzero(half == side)
    model, z = Model(np.zeros(BUCKETS, np.float32), 20.0 * (2 * int(y[0]) - 1)), []
    if y.min() != y.max():
        if side != WHOLE and (len(np.unique(y[mine])) < 2 or not y[rest].any()):
            return pd.DataFrame(columns=["side", "weights", "bias", "z", "y"])
        model = joint([bags[k] for k in mine], y[mine], EPOCHS)
        z = logits(model, [bags[k] for k in rest]).tolist() if len(rest) else []
    return pd.DataFrame([{"side": side, "weights": model.weights.tobytes() if side == WHOLE else b"", "bias": model.bias, "z": z, "y": y[rest].tolist()}])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learns from labelled rows; the caller leaves out what must be held out."""
    few = chosen(labels.filter(f"doc_id is not null and {label} in (0, 1)").select("doc_id", label).distinct(), label)
    # The sample's size bounds what is broadcast, and what a task trains on.
    rows = examples(one_text(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "doc_id", label), label)
    # Three partitions, a model for each (hashes of -1, 0 and 1 differ by 3): left to itself Spark puts small groups into one task.
    each = checkpoint(rows).withColumn("side", F.explode(F.array(*map(F.lit, (WHOLE, 0, 1))))).repartition(3, "side")
    found = {r.side: r for r in each.groupBy("side").applyInPandas(train, "side int, weights binary, bias double, z array<double>, y array<int>").collect()}
    if WHOLE not in found:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    weights, bias = np.frombuffer(bytes(found[WHOLE].weights), np.float32), found[WHOLE].bias
    z, y = (np.array([v for side in (0, 1) if side in found for v in found[side][k]]) for k in ("z", "y"))
    cut = best_cut(z, y.astype(np.int64)) if 0 in found and 1 in found and len(z) else 0.0
    return Model(weights, bias - cut)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score, 0 to 1."""
    docs = docs.drop("toxic_score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        m = held.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_bytes(part.column("text"))
                sums, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
                with np.errstate(over="ignore"):
                    for row, bucket in gram_hashes(data, offsets, LENGTHS, BITS, WORD_BYTES, True):
                        sums += np.bincount(row, m.weights[bucket], part.num_rows)
                        n += np.bincount(row, minlength=part.num_rows)
                z = np.clip(sums / np.maximum(1, n) + m.bias, -30, 30)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=[*part.schema.names, "toxic_score"])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores all documents; rows whose crc32(doc_id) mod 5 is 0 are held out of training."""
    from plumbline.sources import load

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").filter(crc_mod_column(F.col("doc_id"), 5) != 0)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (crc_mod_column(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
