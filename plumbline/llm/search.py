"""Ranked lexical search over a clustered index of reordered documents, with exact stopping.

Reordering: recursive graph bisection of the graph of documents and terms. The bisection itself is
fitted on a bounded sample (SAMPLE_DOCS documents, terms hashed to TERM_BITS): from halves in hashed
order, documents are swapped while that lowers the log-gap cost of the terms' lists. Each cut is kept
as a weight for each term, the gain of being on the left, and a threshold, so that every document,
the sample's included, walks down the same tree to a leaf: its place in the order.

Index: the documents of a leaf, in several shards if they have many postings, lie together as one row
of arrays. For every term a shard knows the highest contribution that any of its documents has, so
that a sum over a query's terms bounds the scores of all its documents.

Search: a query visits the shards of the highest bounds first, a few at a time, and stops where the
bound of the next is under the score that its k-th best document has by then. That is exact: a
shard left out has no document of that score. Positions in the index are mapped back to doc_id
before ties are broken by it.

Postings are kept for the terms of the stated queries only. Queries are taken in blocks of BLOCK_TERMS
terms; one block's terms are on an executor at a time.

Null texts and texts without terms are not counted as documents of the collection and never found.
Rows that repeat a doc_id are documents of their own; documents without an id come last among equal
scores. Items without terms or without an id find nothing; rows that repeat an item_id are one item
with the terms of all. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, WORD_BYTES, checkpoint, documents, size_checked, slices

TOP = 50
#: Documents on which the tree of cuts is fitted, and its depth: up to 64 leaves.
SAMPLE_DOCS, DEPTH, TERM_BITS, SWAPS = 4096, 6, 15, 12
#: Postings in a shard on average at most: what one row holds and one task looks at.
SHARD_POSTINGS = 400_000
#: Terms of the queries of a block at most, repeats counted.
BLOCK_TERMS = 1_000_000
#: Shards that a query visits first; every further round has so many times as many.
FIRST, MORE = 4, 4


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def bucket(term: bytes) -> int:
    return zlib.crc32(term) >> (32 - TERM_BITS)


# Reordering


@dataclass(frozen=True)
class Cuts:
    """A complete tree of cuts, node k has the children 2k + 1 and 2k + 2."""

    weights: np.ndarray  # nodes x buckets
    limits: np.ndarray  # of each node; above it is left


def cost(inside: np.ndarray, n: int) -> np.ndarray:
    """Bits of the gaps of each term's list, if its documents lie evenly in a half of n."""
    return inside * np.log2((n + 1) / (inside + 1))


def bisected(rows: list[np.ndarray], mine: np.ndarray, swaps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights and the limit of a cut through the documents `mine` (rows: their buckets), and which are left."""
    at = np.repeat(np.arange(len(mine)), [len(rows[i]) for i in mine])
    terms = np.concatenate([rows[i] for i in mine]) if len(mine) else np.zeros(0, np.int64)
    buckets, half = 1 << TERM_BITS, len(mine) // 2
    left = np.arange(len(mine)) < half
    inside = [np.bincount(terms[left[at] == side], minlength=buckets).astype(float) for side in (True, False)]
    n = half, len(mine) - half

    def toward_left():
        """What a term's cost falls by if one of its documents is on the left rather than on the right."""
        a, b = inside
        return (cost(a, n[0]) + cost(b + 1, n[1])) - (cost(a + 1, n[0]) + cost(b, n[1]))

    for _ in range(swaps):
        gain = np.bincount(at, toward_left()[terms], len(mine))
        over = np.flatnonzero(left)[np.argsort(gain[left], kind="stable")]
        back = np.flatnonzero(~left)[np.argsort(-gain[~left], kind="stable")]
        m = min(len(over), len(back))
        better = int((gain[back[:m]] - gain[over[:m]] > 1e-9).sum())
        if not better:
            break
        left[over[:better]], left[back[:better]] = False, True
        inside = [np.bincount(terms[left[at] == side], minlength=buckets).astype(float) for side in (True, False)]
    weights = toward_left()
    gain = np.sort(np.bincount(at, weights[terms], len(mine)))
    limit = float(gain[len(gain) // 2 - 1 : len(gain) // 2 + 1].mean()) if len(gain) > 1 else 0.0
    return weights.astype(np.float32), limit


def bisect(rows: list[np.ndarray], depth: int = DEPTH, swaps: int = SWAPS) -> Cuts:
    """rows: the distinct buckets of each document of the sample."""
    nodes = (1 << depth) - 1
    cuts = Cuts(np.zeros((nodes, 1 << TERM_BITS), np.float32), np.zeros(nodes))
    parts = {0: np.arange(len(rows))}
    for k in range(nodes):
        mine = parts.pop(k)
        if len(mine) > 1:
            cuts.weights[k], cuts.limits[k] = bisected(rows, mine, swaps)
        left = np.array([cuts.weights[k][rows[i]].sum(dtype=np.float64) > cuts.limits[k] for i in mine], bool)
        parts[2 * k + 1], parts[2 * k + 2] = mine[left], mine[~left]
    return cuts


def leaf_of(cuts: Cuts, buckets: np.ndarray) -> int:
    k = 0
    while k < len(cuts.limits):
        k = 2 * k + (1 if cuts.weights[k][buckets].sum(dtype=np.float64) > cuts.limits[k] else 2)
    return k - len(cuts.limits)


# Index


@dataclass(frozen=True)
class Queries:
    items: list[str]
    terms: list[np.ndarray]  # of each item: places in the vocabulary, sorted
    vocabulary: dict[bytes, int]


def block_of(items: list[tuple[str, str]]) -> Queries:
    """One block of (item, text)."""
    of: dict[str, set[bytes]] = {}
    for item, text in items:
        if words := terms_of(text):
            of.setdefault(item, set()).update(words)
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*of.values())))}
    names = sorted(of)
    return Queries(names, [np.array(sorted(vocabulary[t] for t in of[i]), np.int64) for i in names], vocabulary)


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms in the text), terms and tfs (of the vocabulary only) of every document that has terms."""

    def counted(batches):
        known = vocabulary.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes, terms, tfs = [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if words := terms_of(text):
                        found = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
                        ids.append(doc)
                        sizes.append(len(words))
                        terms.append([t for t, _ in found])
                        tfs.append([c for _, c in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n long, terms array<int>, tfs array<long>")


def fit_cuts(found: DataFrame, rows: int, names: list[bytes]) -> Cuts:
    """The tree of cuts, from about SAMPLE_DOCS documents by the hash of their id and size."""
    place = F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 20))
    few = found.filter(place < (1 << 20) * min(1.0, SAMPLE_DOCS / max(1, rows))).orderBy(place, "doc_id", "n").limit(SAMPLE_DOCS)
    of = np.array([bucket(t) for t in names], np.int64)
    return bisect([np.unique(of[np.array(r.terms, np.int64)]) for r in few.select("terms").collect()])


SHARD = "shard long, ids binary, unknown binary, sizes binary, terms binary, starts binary, docs binary, tfs binary"


def built(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """One shard: its documents in order of doc_id, and the lists of their terms."""
    unknown, ids = part["unknown"].to_numpy(bool), part["doc_id"].to_numpy(np.int64)
    order = np.lexsort((part["n"].to_numpy(), ids, unknown))
    terms, tfs = part["terms"].to_numpy()[order], part["tfs"].to_numpy()[order]
    doc = np.repeat(np.arange(len(order), dtype=np.int32), [len(t) for t in terms])
    term, tf = (np.concatenate(x).astype(kind) if len(doc) else np.zeros(0, kind) for x, kind in ((terms, np.int32), (tfs, np.int64)))
    by = np.argsort(term, kind="stable")
    names, starts = np.unique(term[by], return_index=True)
    row = {"shard": key[0], "ids": ids[order], "unknown": unknown[order], "sizes": part["n"].to_numpy(np.int64)[order], "terms": names, "starts": np.append(starts, len(term)).astype(np.int64), "docs": doc[by], "tfs": tf[by]}
    return pd.DataFrame([{k: v.tobytes() if k != "shard" else v for k, v in row.items()}])


@dataclass(frozen=True)
class Index:
    shards: DataFrame  # SHARD
    documents: int
    words: int
    df: np.ndarray  # of each term of the vocabulary


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> Index:
    """The clustered index of all documents for the terms of a vocabulary."""
    spark = docs.sparkSession
    found = checkpoint(postings(docs, spark.sparkContext.broadcast(vocabulary)).withColumn("mark", F.monotonically_increasing_id()))
    rows, words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the vocabulary
    df[counts["term"].to_numpy()] = counts["count"].to_numpy()
    names = sorted(vocabulary, key=vocabulary.get)
    cuts = spark.sparkContext.broadcast(fit_cuts(found, rows, names))
    buckets = spark.sparkContext.broadcast(np.array([bucket(t) for t in names], np.int64))

    def placed(batches):
        for batch in batches:
            leaves = [leaf_of(cuts.value, np.unique(buckets.value[np.array(t, np.int64)])) for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int32())], names=[*batch.schema.names, "leaf"])

    at = checkpoint(found.filter(F.size("terms") > 0).mapInArrow(placed, f"{', '.join(f'{k} {v}' for k, v in found.dtypes)}, leaf int"))
    pieces = at.groupBy("leaf").agg(F.ceil(F.sum(F.size("terms")) / SHARD_POSTINGS).alias("pieces"))
    shard = F.col("leaf") + F.shiftleft(F.pmod(F.xxhash64("mark"), F.col("pieces")), DEPTH)
    dealt = at.join(F.broadcast(pieces), "leaf")  # a row for each leaf
    id_of = F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id")
    shards = dealt.select(shard.cast("long").alias("shard"), id_of, F.isnull("doc_id").alias("unknown"), "n", "terms", "tfs").groupBy("shard").applyInPandas(built, SHARD)
    return Index(checkpoint(shards), rows, int(words), df)


# Search


class Shard:
    """A shard with the contribution of every posting, but for its term's weight."""

    def __init__(self, row: dict, documents: int, words: int):
        read = lambda k, kind: np.frombuffer(row[k], kind)
        self.ids, self.unknown, self.terms, self.starts, self.docs = read("ids", np.int64), read("unknown", bool), read("terms", np.int32), read("starts", np.int64), read("docs", np.int32)
        m = np.array([100 - 50 + (50 * int(n) * documents) // words for n in read("sizes", np.int64)], np.int64)
        tf = read("tfs", np.int64)
        self.parts = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])
        self.most = np.maximum.reduceat(self.parts, self.starts[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def bound(self, terms: np.ndarray, weights: np.ndarray) -> int:
        """No document of the shard has a higher score."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        held = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return int((weights[terms[held]] * self.most[at[held]]).sum())

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int, least: int) -> list[tuple[int, int | None]]:
        """(score, doc_id) of the best documents with a score of `least` or more."""
        score = np.zeros(len(self.ids), np.int64)
        at = np.searchsorted(self.terms, terms)
        for k, t in zip(at, terms, strict=True):
            if k < len(self.terms) and self.terms[k] == t:
                a, b = self.starts[k], self.starts[k + 1]
                score[self.docs[a:b]] += weights[t] * self.parts[a:b]
        some = np.flatnonzero(score >= max(1, least))
        some = some[np.argsort(-score[some], kind="stable")][:top]  # a shard's documents lie in order of doc_id
        return [(int(score[i]), None if self.unknown[i] else int(self.ids[i])) for i in some]


def weights_of(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(k) + 1))) for k in df], np.int64)


def shard_rows(batches):
    """The shards of a batch one after another, so that only one is unpacked at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def bounds(held: Index, block) -> DataFrame:
    """item (its place in the block), shard and bound, where the bound is above 0."""
    n, words = held.documents, held.words

    def bounded(batches):
        terms, weights = block.value
        for row in shard_rows(batches):
            shard = Shard(row, n, words)
            found = [(k, b) for k, t in enumerate(terms) if (b := shard.bound(t, weights)) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([row["shard"]] * len(found), pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["item", "shard", "bound"])

    return held.shards.mapInArrow(bounded, "item int, shard long, bound long")


def visited(held: Index, block, visits: DataFrame, n_visits: int, top: int) -> DataFrame:
    """item, score, doc_id: the best documents of the shards that items visit (item, shard, least)."""
    n, words = held.documents, held.words
    asked = visits.groupBy("shard").agg(F.collect_list(F.struct("item", "least")).alias("asked"))
    met = held.shards.join(size_checked(asked, n_visits, 1_000_000), "shard")

    def look(batches):
        terms, weights = block.value
        for row in shard_rows(batches):
            shard = Shard(row, n, words)
            found = [(x["item"], s, d) for x in row["asked"] for s, d in shard.best(terms[x["item"]], weights, top, x["least"])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "score", "doc_id"])

    return met.mapInArrow(look, "item int, score long, doc_id long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(held: Index, queries: Queries, top: int = TOP, first: int = FIRST) -> DataFrame:
    """item, rank, doc_id and score of each query's best documents."""
    spark = held.shards.sparkSession
    block = spark.sparkContext.broadcast((queries.terms, weights_of(held.documents, held.df)))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    waiting = checkpoint(bounds(held, block).withColumn("turn", F.row_number().over(order)))
    done, best, least = 0, None, None
    while True:
        upto = first if not done else done * (MORE + 1)
        if least is not None:
            waiting = waiting.drop("least").join(size_checked(least, len(queries.items)), "item", "left")
        else:
            waiting = waiting.withColumn("least", F.lit(1).cast("long"))
        waiting = waiting.withColumn("least", F.coalesce("least", F.lit(1))).filter((F.col("turn") > done) & (F.col("bound") >= F.col("least")))
        visits = checkpoint(waiting.filter(F.col("turn") <= upto).select("item", "shard", "least"))
        if not (n := visits.count()):
            break
        found = visited(held, block, visits, n, top)
        best = checkpoint(best_of(found if best is None else found.unionByName(best.drop("rank")), top))
        least = best.filter(F.col("rank") == top).select("item", F.col("score").alias("least"))
        done = upto
    if best is None:
        return spark.createDataFrame([], "item string, rank int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(queries.items)), "_k int, item string")
    return best.withColumnRenamed("item", "_k").join(F.broadcast(names), "_k").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item (item_id as text), rank, doc_id and score of the `top` best documents of every row of items (item_id, text)."""
    asked = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    total = asked.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))), F.lit(0))).first()[0]
    blocks, out = max(1, -(-total // block_terms)), None
    for k in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        queries = block_of([(r.item, r.text) for r in mine.distinct().collect()])
        found = ranked(index(docs, queries.vocabulary), queries, top)
        out = found if out is None else out.unionByName(found)
    return out


def op13_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each item of `benchmark`."""
    from plumbline.sources import load

    items = load(spark, sf_dir, "benchmark")
    kind = items.schema["item_id"].dataType
    found = search(documents(spark, sf_dir), items.select("item_id", "text"))
    return found.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as w from documents where text is not null),
s as (select count(*) as big_n, sum(len(w))::bigint as l from d where len(w) > 0),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark where text is not null and item_id is not null),
v as (select distinct term from q),
p as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) semi join v using (term) group by all),
i as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by term, big_n),
m as (select r, doc_id, 100 - 50 + ((50 * len(w) * big_n) // l) as m from d, s),
x as (select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join p using (term) join i using (term) join m using (r) group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score
from x join m using (r) where score > 0 qualify rank <= {TOP}"""
