"""Language identification in two levels: the family first, then the language within it.

A text is the square roots of its hashed byte 2- and 3-gram counts (A-Z lowered, digits and
ASCII punctuation as blanks), scaled to length 1. A softmax over families decides first. Within
the family one linear support vector machine (squared hinge) for each pair of languages votes.

Training reads about SAMPLE_ROWS texts in all, shared evenly by the MOST_LANGS most frequent languages
(rarer ones are not learned) and chosen by the hash of the id; of rows that repeat a doc_id that with the smallest hash of its text is learned from. Prediction reads whole texts. Texts that are null or have no letter
(Unicode category L; numerals such as the fraction one half are none) are `und` with score 0. Without any labelled text every text is `und`. Repeated documents are separate rows,
empty tables give no rows; other columns are passed on, those named like results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_BYTES, crc_mod_column, documents, slices, text_bytes
from plumbline.llm.ngrams import counts

BITS, LENGTHS = 12, (2, 3)
SAMPLE_ROWS = 2000
#: Bytes and rows of a slice. A row of features has 2**BITS numbers however short its text is.
SLICE, SLICE_ROWS = 1 << 19, 128
UNKNOWN = "und"
#: Languages that are learned at most: the most frequent ones.
MOST_LANGS = 100
#: Digits are no evidence of a language.
TABLE = bytes(32 if 48 <= c <= 57 else w for c, w in enumerate(WORD_BYTES))
#: Languages by family; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es pt it ro ca gl oc la rm sc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi ur bn pa gu mr ne si as or sa",
    "iranian": "fa ps ku tg",
    "turkic": "tr az kk ky uz tk tt ug",
    "uralic": "fi et hu se",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg mi",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


@dataclass(frozen=True)
class Model:
    families: list[str]
    langs: dict[str, list[str]]  # of each family, sorted
    level: np.ndarray  # features + 1 x families
    pairs: dict[str, np.ndarray]  # of each family with several languages: features + 1 x pairs


def features(column: pa.Array) -> np.ndarray:
    """Rows of length 1 (0 without n-grams), float32, and a constant 1 at the end."""
    x = np.sqrt(counts(column, LENGTHS, BITS, TABLE, False), dtype=np.float32)
    x /= np.maximum(1e-9, np.sqrt((x * x).sum(1, keepdims=True)))
    return np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)


def adam(gradient, shape, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    w, m, s = (np.zeros(shape, np.float32) for _ in range(3))
    for k in range(1, steps + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        w -= rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return w


def train(x: np.ndarray, langs: list[str], penalty: float = 1e-4) -> Model:
    """x: features(); langs: of each row."""
    of = np.array([family_of(v) for v in langs])
    families = sorted(set(of))
    names = {f: sorted({v for v in langs if family_of(v) == f}) for f in families}
    y = np.searchsorted(families, of) if families else np.zeros(0, int)
    langs = np.array(langs)
    even = (1 / np.maximum(1, np.bincount(y, minlength=len(families)))[y] / max(1, len(families)))[:, None].astype(np.float32)

    def softmax_gradient(w):
        z = x @ w
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        return x.T @ (z * even) + penalty * w

    level = adam(softmax_gradient, (x.shape[1], len(families))) if len(families) > 1 else np.zeros((x.shape[1], len(families)), np.float32)
    pairs = {}
    for f in families:
        cols = []
        for a, b in combinations(names[f], 2):
            rows = (langs == a) | (langs == b)
            xs, sign = x[rows], np.where(langs[rows] == a, 1, -1).astype(np.float32)
            share = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum()).astype(np.float32)
            cols.append(adam(lambda w, xs=xs, sign=sign, share=share: xs.T @ (-2 * np.maximum(0, 1 - sign * (xs @ w)) * sign * share) + penalty * w, x.shape[1]))
        if cols:
            pairs[f] = np.stack(cols, 1)
    return Model(families, names, level, pairs)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from docs with a lang and a text; the caller leaves out what must be held out."""
    from plumbline.llm.toxicity import one_text

    known = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    each = max(1, rows // max(1, len(n)))
    if not n:
        return train(np.zeros((0, (1 << BITS) + 1), np.float32), [])
    # As an Arrow table: rows of Python objects would start further Python workers on the executors.
    share = known.sparkSession.createDataFrame(pa.table({"lang": pa.array([r[0] for r in n], pa.string()), "_share": pa.array([each / r[1] for r in n], pa.float64())}))
    few = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).select("doc_id", "lang", "text")
    few = one_text(few, "doc_id", "lang")

    def bags(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_ROWS):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    found = sorted((r.lang, bytes(r.x)) for r in few.mapInArrow(bags, "lang string, x binary").collect())
    return train(np.stack([np.frombuffer(b, np.float32) for _, b in found]) if found else np.zeros((0, (1 << BITS) + 1), np.float32), [v for v, _ in found])


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    n = len(column)
    if not model.families or not n:
        return [UNKNOWN] * n, np.zeros(n)
    x = features(column)
    z = x @ model.level
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    top = z.argmax(1)
    score = z[np.arange(n), top].astype(float)
    langs = np.empty(n, object)
    for k, f in enumerate(model.families):
        at = np.flatnonzero(top == k)
        names = model.langs[f]
        if f not in model.pairs or not len(at):
            langs[at] = names[0]
            continue
        margin = x[at] @ model.pairs[f]
        votes, sure = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
        for p, (a, b) in enumerate(combinations(range(len(names)), 2)):
            likely = 1 / (1 + np.exp(-np.clip(3 * margin[:, p], -30, 30)))
            votes[:, a] += margin[:, p] >= 0
            votes[:, b] += margin[:, p] < 0
            sure[:, a] += likely
            sure[:, b] += 1 - likely
        best = (votes + sure / len(names)).argmax(1)
        langs[at] = np.array(names, object)[best]
        score[at] *= sure[np.arange(len(at)), best] / (len(names) - 1)
    data, offsets = text_bytes(column)
    part = data[offsets[0] : offsets[-1]]
    seen = np.concatenate([[0], np.cumsum((np.frombuffer(TABLE, np.uint8)[part] >= 97) & (part < 128))])
    ascii_letters = seen[offsets[1:] - offsets[0]] - seen[offsets[:-1] - offsets[0]]
    for k in np.flatnonzero(ascii_letters == 0):
        if not any(map(str.isalpha, column[int(k)].as_py() or "")):
            langs[k], score[k] = UNKNOWN, 0.0
    return list(langs), score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score."""
    docs = docs.drop("lang_pred", "lang_score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def named(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_ROWS):
                langs, score = predict(held.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Language of all documents; rows whose crc32(doc_id) mod 3 is 1 are held out of training."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(crc_mod_column(F.col("doc_id"), 3) != 1))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod_column(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
