"""Grouping of spelling variants: words that are one inserted, deleted or replaced code point apart.

Rare-first prefix filter. A word's bigrams are put in one global order, rarest first (ties by bigram,
then place). One edit touches two bigrams of a word at most, so two near words have one of their three
rarest in common, at places that differ by one at most: only those three are joined. The edit lies on
one side of the bigram they share: the other side is the same in both words, and so is one half of
the side with the edit. So a word comes into the join under four keys for each bigram: its place and
the word's length, one side with the bigram, and a half of the other side. It meets words of its own
length under the same keys, and words longer by one with the place and the halves as the insertion
moves them. What meets is verified by the edit distance. No bucket holds all words with a common bigram.

A word's form is its near word of largest n, by ties the smallest in code-point order, if that n is
`ratio` times its own; forms are followed to the last, by doubling: n grows at each step, so there
are no rings.

Texts that are null have no words; very long runs are words like any other; repeated rows count
again. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, checkpoint, documents, lower_ascii, size_checked

#: A-Z, a-z and the letters (and two signs) of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Of every so many occurrences one loses a code point (the query's planted misspellings).
NOISE = 31
RAREST = 3
#: Places of bigrams are counted by so many bits of the bigram's hash, so that the table of the order is bounded for
#: any alphabet. (The query's runs have at most 90 * 90 bigrams.)
ORDER_BITS = 16


def runs(docs: DataFrame, least: int) -> DataFrame:
    """doc_id and run: lower-cased maximal runs of letters, of `least` code points or more."""
    found = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(doc_id: Column, run: Column, every: int = NOISE) -> Column:
    """The run, without one code point where `every` divides the crc32 of `<doc_id>:<run>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.overlay(run, F.lit(""), at + 1, F.lit(1))).otherwise(run)


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words (column word) that are long and frequent enough."""
    if least_length < RAREST + 1:
        raise ValueError(f"one edit may touch all bigrams of words under {RAREST + 1} code points")
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def bucket_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) >> (32 - ORDER_BITS)


def places(words: DataFrame) -> list[int]:
    """How many places of all words have a bigram of each bucket."""

    def count(batches):
        found: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                found.update(map(str.__add__, w, w[1:]))
            if len(found) > 1 << ORDER_BITS:
                yield packed(found)
                found.clear()
        yield packed(found)

    def packed(found):
        return pa.RecordBatch.from_arrays([pa.array([bucket_of(g) for g in found], pa.int32()), pa.array(found.values(), pa.int64())], names=["bucket", "places"])

    out = [0] * (1 << ORDER_BITS)
    for r in words.select("word").mapInArrow(count, "bucket int, places long").groupBy("bucket").agg(F.sum("places").alias("places")).collect():
        out[r.bucket] = r.places
    return out


def hashed(*parts) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), signed=True)


def keys_of(word: str, places: list[int]):
    """(longer, key) of a word's rarest bigrams: its own keys, and those of words longer by one that it meets."""
    n = len(word)
    if n < 2:
        return
    rarest = heapq.nsmallest(RAREST, ((places[bucket_of(g)], g, p) for p, g in enumerate(map(str.__add__, word, word[1:]))))
    for *_, p in rarest:
        # The side that is the same, the side with the edit, and how far an insertion there moves the bigram.
        for side, same, other, moved in (("<", word[: p + 2], word[p + 2 :], 0), (">", word[p:], word[:p], 1)):
            half = len(other) // 2
            yield False, hashed(side, p, n, same, 0, other[:half])
            yield False, hashed(side, p, n, same, 1, other[half:])
            half = (len(other) + 1) // 2  # of the longer side
            yield True, hashed(side, p + moved, n + 1, same, 0, other[:half])
            if half:
                yield True, hashed(side, p + moved, n + 1, same, 1, other[half - 1 :])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: all pairs of words (word, n) that are one edit apart, once."""
    order = words.sparkSession.sparkContext.broadcast(places(words))

    def entries(meeting: bool) -> DataFrame:
        """A row for each key of a word; those of longer words only for the side that meets them."""

        def keyed(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 2000):
                    part = batch.slice(start, 2000)
                    found = [(k, key) for k, w in enumerate(part.column("word").to_pylist()) for longer, key in keys_of(w, order.value) if meeting or not longer]
                    taken = part.take(pa.array([k for k, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([key for _, key in found], pa.int64())], names=["word", "n", "key"])

        return words.select("word", "n").mapInArrow(keyed, "word string, n long, key long")

    a, b = entries(True).withColumnsRenamed({"word": "a", "n": "a_n"}), entries(False).withColumnsRenamed({"word": "b", "n": "b_n"})
    # Of one length each pair meets from both sides: one is enough.
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = a.join(b, "key").filter(ordered & (F.levenshtein("a", "b", 1) == 1))
    return met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n and n_near of every word."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"), F.count(F.lit(1)).alias("n_near"))
    clear = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, F.col("best.other")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word and root of every word that has a form; each round doubles the steps taken."""
    step = checkpoint(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        to = size_checked(step.select(F.col("word").alias("root"), F.col("root").alias("next")), step.count())
        further = checkpoint(step.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not further.filter("moved").take(1):
            return further.select("word", "root")
        step = further.drop("moved")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of a table of distinct words and their counts."""
    words = checkpoint(words)
    formed = checkpoint(forms(words, checkpoint(near_pairs(words)), ratio))
    last = roots(formed)
    return formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all documents, some occurrences of which lose a code point, with their forms and roots."""
    found = runs(documents(spark, sf_dir).select("doc_id", "text"), LEAST_LENGTH)
    return group(counted(found.select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))))


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32, from its polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


SQL = f"""
with d as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) as w from documents where text is not null),
o as (select doc_id, w, count(*) as k from d where length(w) >= {LEAST_LENGTH} group by all),
b as (select *, string_split(regexp_replace(hex(encode(coalesce(doc_id::varchar, '') || ':' || w)), '(..)', '\\1 ', 'g'), ' ') as bytes from o),
h as (select w, k, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(bytes[:-2], lambda x: ('0x' || x)::bigint)),
    lambda c, x: xor(c >> 8, ({_crc_table()}::bigint[])[xor(c, x) % 256 + 1]))) as h from b),
m as (select case when h % {NOISE} = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, k from h),
v as (select word, sum(k)::bigint as n from m where length(word) >= {LEAST_LENGTH} group by word having sum(k) >= {LEAST_COUNT}),
x as (select word, n, substr(word, 1, i) || substr(word, i + 2) as rest, i from (select *, unnest(range(0, length(word))) as i from v)),
near as (
    select a.word, b.word as other, b.n as other_n from x a join x b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from x a join v b on a.rest = b.word
    union select b.word, a.word, a.n from x a join v b on a.rest = b.word),
s as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
f as (select v.word, n, coalesce(n_near, 0) as n_near, case when other_n >= {RATIO} * n then other end as form, case when other_n >= {RATIO} * n then other_n end as form_n from v left join s using (word)),
r as (with recursive g as (select word, coalesce(form, word) as root, form from f union select g.word, f.form, f.form from g join f on g.root = f.word where f.form is not null)
    select word, arg_max(root, (select n from v where v.word = root)) as root from g group by word)
select word, n, n_near, form, form_n, root from f join r using (word)"""
