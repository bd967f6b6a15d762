"""Exact deduplication of a batch of documents against immutable snapshots.

A snapshot never changes once made: for every distinct text its digest, the largest doc_id and the
number of rows, and binary-fuse filters of the digests, one for each shard of the digest space. Its
texts stay where they are (the exact buckets).

A batch's rows are grouped by digest among themselves first, without their texts. Its digests are
screened by the filters. What a filter lets not pass is new: it meets neither digest nor text of the
snapshot. Only the digests that pass (repeats, and 1 in 256 others) are joined with the snapshot's;
both sides bring one text each to their bucket, and the bytes decide. Rows look up their group only
among digests that occur more than once, or on both sides; any other row is its own group.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
row with the largest doc_id stays (null is below any id); of several such rows, one. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, checkpoint, documents, join_hot, lower_ascii, size_checked

#: Digests in a filter on average: what one task peels or probes at a time.
FILTER_KEYS = 65_536
#: Digests whose texts are looked up by broadcast at most; with more, the texts are shuffled.
FEW_DIGESTS = 500_000


@dataclass(frozen=True)
class Snapshot:
    docs: DataFrame  # text and more: the exact buckets are read from it
    groups: DataFrame  # of each digest old_keep (doc_id and mark of the row that stays) and old_n
    filters: DataFrame  # shard, seed, length, segments, prints
    shards: int
    rows: int


def digested(docs: DataFrame) -> DataFrame:
    """docs with bytes (normalised text) and digest (its SHA-256)."""
    return docs.withColumn("bytes", lower_ascii(F.coalesce("text", F.lit("")))).withColumn("digest", F.unhex(F.sha2("bytes", 256)))


def slim(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, digest and mark (a number of its own) of every row, and other columns, kept: no text."""
    return checkpoint(digested(docs).select("doc_id", "digest", *more).withColumn("mark", F.monotonically_increasing_id()))


def grouped(rows: DataFrame) -> DataFrame:
    """digest, keep (doc_id and mark of the row that stays), n: a row for each digest."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "mark")).alias("keep"), F.count(F.lit(1)).alias("n"))


def shard_of(digest, shards: int):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def keys_of(digests: pd.Series):
    import numpy as np

    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), ">u8").astype(np.uint64)


def snapshot(docs: DataFrame, known: DataFrame | None = None) -> Snapshot:
    """Filters of all rows of docs. known: slim(docs), where it is there already."""
    known = slim(docs) if known is None else known
    rows = known.count()
    shards = max(1, -(-rows // FILTER_KEYS))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from plumbline.llm.fuse import FuseFilter

        f = FuseFilter.build(np.unique(keys_of(part["digest"])))
        return pd.DataFrame([{"shard": key[0], "seed": f"{f.seed}", "length": f.length, "segments": f.segments, "prints": f.prints.tobytes()}])

    digests = known.select("digest").distinct().withColumn("shard", shard_of("digest", shards))
    filters = checkpoint(digests.groupBy("shard").applyInPandas(build, "shard int, seed string, length int, segments int, prints binary"))
    groups = checkpoint(grouped(known).withColumnsRenamed({"keep": "old_keep", "n": "old_n"}))
    return Snapshot(docs, groups, filters, shards, rows)


def screen(digests: DataFrame, rows: int, snap: Snapshot) -> DataFrame:
    """The digests that a snapshot's filters let pass. rows: of the batch, to size the groups."""
    salts = max(1, -(-rows // max(1, snap.rows)))
    salt = F.pmod(F.hash("digest"), F.lit(salts))

    def probe(key: tuple, batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from plumbline.llm.fuse import FuseFilter

        if not len(filters) or not len(batch):
            return batch[["digest"]].iloc[:0]
        f = filters.iloc[0]
        held = FuseFilter(int(f["seed"]), int(f["length"]), int(f["segments"]), np.frombuffer(f["prints"], np.uint8))
        return batch[["digest"]][held.contains(keys_of(batch["digest"]))]

    batch = digests.withColumn("shard", shard_of("digest", snap.shards)).withColumn("salt", salt)
    filters = snap.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return batch.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(probe, "digest binary")


def bucketed(docs: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    """digest and bytes of one text for each of these n digests; equal texts of a task meet before they are sent."""
    texts = digested(docs.select("text")).select("digest", "bytes").join(size_checked(digests, n, FEW_DIGESTS), "digest", "left_semi")
    return texts.groupBy("digest").agg(F.any_value("bytes").alias("bytes"))


def dedup(batch: DataFrame, snap: Snapshot, known: DataFrame | None = None) -> DataFrame:
    """digest, keep, n, old_keep, old_n, same: the groups of digests that the batch or the snapshot has more than
    once, or both have; same says whether the texts of both are one.

    known: slim(batch), where it is there already.
    """
    known = slim(batch) if known is None else known
    new = checkpoint(grouped(known))
    passed = checkpoint(screen(new.select("digest"), known.count(), snap))
    n = passed.count()
    few = size_checked(passed, n, FEW_DIGESTS)
    one, two = bucketed(batch, passed, n), bucketed(snap.docs, passed, n).withColumnRenamed("bytes", "old_bytes")
    same = one.join(two, "digest").filter(F.col("bytes") == F.col("old_bytes")).select("digest", F.lit(True).alias("same"))
    both = new.join(few, "digest", "left_semi").join(snap.groups.join(few, "digest", "left_semi"), "digest")
    both = checkpoint(both.join(same, "digest", "left").withColumn("same", F.coalesce("same", F.lit(False))))
    met = size_checked(both.select("digest"), n, FEW_DIGESTS)
    alone = new.filter("n > 1").join(met, "digest", "left_anti").unionByName(snap.groups.filter("old_n > 1").join(met, "digest", "left_anti"), allowMissingColumns=True)
    return both.unionByName(alone.withColumn("same", F.lit(False)))


def decided(docs: DataFrame, old) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row of docs; rows where `old` holds are the
    snapshot, the others the batch."""
    docs = docs.select("doc_id", "text", F.coalesce(old, F.lit(False)).alias("old"))
    rows = slim(docs, "old")
    snap = snapshot(docs.filter("old"), rows.filter("old"))
    groups = dedup(docs.filter("not old"), snap, rows.filter("not old"))
    groups = checkpoint(groups.withColumn("size", F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))))
    n = groups.count()
    met = rows.join(F.broadcast(groups), "digest", "left") if n <= FEW_DIGESTS else join_hot(rows, groups, "digest")
    itself = F.struct("doc_id", "mark")
    keep = F.when(F.col("same"), F.greatest("keep", "old_keep")).when(F.col("old"), F.coalesce("old_keep", itself)).otherwise(F.coalesce("keep", itself))
    size = F.when(F.col("same"), F.col("size")).when(F.col("old"), F.coalesce("old_n", F.lit(1))).otherwise(F.coalesce("n", F.lit(1)))
    met = met.withColumns({"_keep": keep, "group_size": size})
    return met.select("doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("mark") == F.col("_keep.mark")).alias("kept"), "digest")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents whose hashed id is even are the snapshot, the others the batch; all are returned."""
    found = decided(documents(spark, sf_dir), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


SQL = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
    row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256 from d"""
