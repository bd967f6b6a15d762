"""Benchmark decontamination by Wu-Manber search for many word windows at once.

The symbols are words. All windows of one length m form a table: `shift` says for a block of two
words how far the search may move on before any window could end there, `buckets` has for a block
that ends a window the windows by their first word, and those are compared word by word. Blocks
that end in no window are skipped, so that about one word in m - 1 is looked at.

A benchmark of up to ITEM_BYTES of text is on every executor as such tables. A larger one is a table of
windows: executors hold its shifts by the hash of a block and a bitmap of the hashes of windows, both of
bounded size, and one pass over the documents gives the places that neither rules out. These meet the
windows of their hash in a join, and the words decide. Hits add up by a number that each row has.

A null or wordless text has no words and no hits. Items without words or without an id never
occur; rows that repeat an item_id are one item. Repeated documents are separate rows. Empty
tables give no rows, or no hits. Other columns are passed on; those named like results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_BYTES, checkpoint, documents, size_checked, slices, unused

WINDOW = 10
ITEM_BYTES = 1 << 20
#: Bits of a block's hash in the shifts of a large benchmark (a byte for each), and of a window's hash in its bitmap.
SHIFT_BITS, WINDOW_BITS = 22, 27


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class WindowTable:
    """Wu-Manber tables of windows that all have m words."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], tuple[str, ...]]):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for window, ids in windows.items():
            for end in range(self.block, m + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), m - end)
            self.buckets[window[m - self.block :]][window[0]].append((list(window), ids))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, words: list[bytes]):
        """(start, item ids) of each window that occurs, by its place."""
        m, block, most, shift, n = self.m, self.block, self.most, self.shift, len(words)
        end = m
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            if step := shift.get(key, most):
                end += step
                continue
            start = end - m
            for window, ids in self.buckets[key].get(words[start], ()):
                if words[start:end] == window:
                    yield start, ids
            end += 1


def tables(items: list[tuple[str, str]], width: int = WINDOW) -> list[WindowTable]:
    """One table for each window length among (item id, text)."""
    windows: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        m = min(width, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            windows[m][tuple(words[k : k + m])].add(item)
    return [WindowTable(m, {w: tuple(ids) for w, ids in found.items()}) for m, found in sorted(windows.items())]


def merged(spans) -> list[list[int]]:
    """Sorted [start, end) spans without overlaps."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def hits(words: list[bytes], found: list[WindowTable]):
    """Merged spans of hit words and the sorted ids of items."""
    spans, items = [], set()
    for table in found:
        for start, ids in table.search(words):
            spans.append((start, start + table.m))
            items.update(ids)
    return merged(spans), sorted(items)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULTS = T.StructType().add("n_words", "long").add("hit_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("hit_items", T.ArrayType(T.StringType()))


def searched(docs: DataFrame, held) -> DataFrame:
    """docs with the results. held: the benchmark's tables, broadcast; without any, words are counted."""

    def search(batches):
        found = held.value if held is not None else []
        for batch in batches:
            for part in slices(batch, "text"):
                n, spans, names = [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    merged, ids = hits(words, found)
                    n.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in merged])
                    names.append(ids)
                made = [pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *RESULTS.names])

    return docs.mapInArrow(search, T.StructType([*docs.schema.fields, *RESULTS]))


def hash_of(words: list[bytes]) -> int:
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest())


@dataclass(frozen=True)
class Filters:
    """For windows of m words: shifts by the hash of a block, and which hashes windows have."""

    m: int
    shifts: np.ndarray
    known: np.ndarray

    def places(self, words: list[bytes]):
        """(start, hash) of the windows that may be of the benchmark."""
        m, block = self.m, min(2, self.m)
        end, n = m, len(words)
        while end <= n:
            if step := int(self.shifts[hash_of(words[end - block : end]) >> (64 - SHIFT_BITS)]):
                end += step
                continue
            key = hash_of(words[end - m : end])
            place = key >> (64 - WINDOW_BITS)
            if self.known[place >> 3] >> (place & 7) & 1:
                yield end - m, key
            end += 1


WINDOWS = "m int, key long, words binary, item string, slots array<int>, steps array<int>"


def windows(ids: DataFrame, width: int) -> DataFrame:
    """Every window of every item: its length, hash (signed), words, item, and the slots of its blocks with their shifts."""

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                item, words = batch.column("item")[k].as_py(), words_of(batch.column("text")[k].as_py())
                m = min(width, len(words))
                block, rows = min(2, m), []
                for at in range(len(words) - m + 1 if m else 0):
                    w = words[at : at + m]
                    slots = [hash_of(w[end - block : end]) >> (64 - SHIFT_BITS) for end in range(block, m + 1)]
                    rows.append((m, hash_of(w), b" ".join(w), item, slots, [m - end for end in range(block, m + 1)]))
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at : at + 10_000], strict=True))
                    keys = np.array(part[1], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(keys), *(pa.array(part[c], kind) for c, kind in ((2, pa.binary()), (3, pa.string()), (4, pa.list_(pa.int32())), (5, pa.list_(pa.int32()))))], names=["m", "key", "words", "item", "slots", "steps"])

    return ids.mapInArrow(cut, WINDOWS)


def filters(found: DataFrame) -> list[Filters]:
    """Of each length of windows. What comes to the driver is bounded by the bits of the hashes, for each of at most `width` lengths."""
    out = []
    for (m,) in found.select("m").distinct().orderBy("m").collect():
        mine = found.filter(F.col("m") == m)
        shifts = np.full(1 << SHIFT_BITS, m - min(2, m) + 1, np.uint8 if m < 256 else np.int32)
        least = mine.select(F.explode(F.arrays_zip("slots", "steps")).alias("x")).groupBy("x.slots").agg(F.min("x.steps").alias("step")).toArrow()
        shifts[least["slots"].to_numpy()] = least["step"].to_numpy()
        mine = mine.select(F.shiftrightunsigned("key", 64 - WINDOW_BITS).alias("place"))
        bits = mine.groupBy(F.shiftright("place", 5).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(place % 32)))").alias("bits")).toArrow()
        known = np.zeros(1 << (WINDOW_BITS - 5), np.uint32)
        known[bits["at"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
        out.append(Filters(m, shifts, known.view(np.uint8)))
    return out


def candidates(marked: DataFrame, held, mark: str) -> DataFrame:
    """mark, m, key, start and words of the windows of documents that the filters let pass: one pass."""

    def search(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for n, text in zip(part.column(mark).to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = words_of(text)
                    rows += [(n, f.m, key, start, b" ".join(words[start : start + f.m])) for f in held.value for start, key in f.places(words)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                keys = np.array(cols[2], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(keys, pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=[mark, "m", "key", "start", "words"])

    return marked.select(mark, "text").mapInArrow(search, f"{mark} long, m int, key long, start long, words binary")


def scan(docs: DataFrame, items: DataFrame, width: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (words from 0, end excluded) and hit_items (ids as text, sorted)."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS.names)
    (mark,) = unused(docs, "_mark")
    ids = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    total = ids.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= item_bytes:
        return searched(docs, spark.sparkContext.broadcast(tables([(r.item, r.text) for r in ids.distinct().collect()], width)))
    marked = checkpoint(docs.withColumn(mark, F.monotonically_increasing_id()))
    found = checkpoint(windows(ids, width))
    held = spark.sparkContext.broadcast(filters(found))
    known = found.select("m", "key", "words", "item").distinct()
    hits = candidates(marked, held, mark).join(known, ["m", "key", "words"])
    span = F.struct(F.col("start"), (F.col("start") + F.col("m")).alias("end"))
    every = hits.groupBy(mark).agg(F.collect_set(span).alias("hit_spans"), F.array_sort(F.collect_set("item")).alias("hit_items"))

    def joined(batches):
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merged((x["start"], x["end"]) for x in row)] for row in batch.column("hit_spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(mark), pa.array(spans, SPANS), batch.column("hit_items")], names=[mark, "hit_spans", "hit_items"])

    every = checkpoint(every.mapInArrow(joined, f"{mark} long, hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<string>"))
    counted = searched(marked, None).drop("hit_spans", "hit_items").join(size_checked(every, every.count()), mark, "left")
    none = [F.coalesce(c, F.array().cast(RESULTS[c].dataType)).alias(c) for c in ("hit_spans", "hit_items")]
    return counted.select(*docs.columns, "n_words", *none)


def op1_decontam(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of `benchmark` in every document, windows of 10 words."""
    from plumbline.sources import load

    found = scan(documents(spark, sf_dir).select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


WORDS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce({WORDS_SQL.format('text')}, []) as w from documents),
b as (select item_id, {WORDS_SQL.format('text')} as w from benchmark where text is not null and item_id is not null),
g as (select distinct item_id, least(10, len(w)) as m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
    from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
l as (select distinct m from g),
p as (select r, m, i, array_to_string(w[i : i + m - 1], ' ') as g from (select r, m, w, unnest(range(1, len(w) - m + 2)) as i from d, l)),
f as (select r, i, m, item_id from p join g using (m, g)),
h as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + m)) as x from f) group by r),
n as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from f) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (r) left join n using (r)"""
