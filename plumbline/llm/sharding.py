"""Shards by extendible hashing: a directory of hash prefixes in which only full buckets split.

A document's key is hashed to 60 bits. Bytes are summed for short prefixes (cells) first; a
shard is the shortest prefix whose documents fit the limit. Cells that are over the limit by
themselves are cut by further bits, and only their rows are read again. Rows with one hash that
together exceed the limit cannot be told apart by bits: they go to overflow pages of the bucket, each
partition of such rows to pages of its own, so that one id's rows are not one task's work.
Only DataFrame operations run; the directory stays a table.

A null text has 0 bytes, a null doc_id is hashed like an empty text, repeated rows are separate.
A document above the limit gets a shard of its own. An empty table gives no rows. Other columns are
passed on whatever their names; those named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint, size_checked

HASH_BITS = 60
#: Cells per shard, as bits: how far below the average shard the first sums reach.
CELL_BITS = 4
MORE_BITS = 8
MAX_SHARD_BYTES = 16 << 20


def hashed(key: Column) -> Column:
    """60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h, bits: int) -> Column:
    return F.shiftrightunsigned(h, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def split(keyed: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """For each cell of `bits` bits: the shortest prefix of over `low` bits that fits, else null.

    keyed: _h, _bytes. Returns _cell, _depth, _prefix, _shard_bytes, _shard_rows.
    """
    cells = keyed.groupBy(prefix("_h", bits).alias("_cell")).agg(F.sum("_bytes").alias("_b"), F.count(F.lit(1)).alias("_n"))
    levels = cells.select("_cell", "_b", "_n", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("_depth"))
    levels = levels.withColumn("_prefix", F.expr(f"shiftrightunsigned(_cell, {bits} - _depth)"))
    sums = levels.groupBy("_depth", "_prefix").agg(F.sum("_b").alias("_shard_bytes"), F.sum("_n").alias("_shard_rows"))
    fits = sums.filter((F.col("_shard_bytes") <= limit) | (F.col("_shard_rows") == 1))
    met = levels.join(fits, ["_depth", "_prefix"], "left")
    best = F.min(F.when(F.col("_shard_bytes").isNotNull(), F.struct("_depth", "_prefix", "_shard_bytes", "_shard_rows")))
    return met.groupBy("_cell").agg(best.alias("_best")).select("_cell", "_best.*")


def directory(keyed: DataFrame, limit: int) -> list[tuple[int, DataFrame, int]]:
    """(bits, table, rows) of each round of splits; a cell without a prefix is split in the next."""
    total = keyed.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    low, bits = 0, min(HASH_BITS, (-(-total // limit)).bit_length() + CELL_BITS)
    out = []
    while True:
        found = checkpoint(split(keyed, low, bits, limit))
        rows, full = found.agg(F.count(F.lit(1)), F.count_if(F.col("_depth").isNull())).first()
        out.append((bits, found, rows))
        if not full or bits == HASH_BITS:
            return out
        over = found.filter("_depth is null").select("_cell")
        keyed = keyed.withColumn("_cell", prefix("_h", bits)).join(size_checked(over, full), "_cell", "left_semi").drop("_cell")
        low, bits = bits + 1, min(HASH_BITS, bits + MORE_BITS)


def shard(docs: DataFrame, limit: int = MAX_SHARD_BYTES) -> DataFrame:
    """docs with shard (prefix bits, page after a dot), depth, doc_bytes, shard_bytes, global_depth."""
    docs = docs.drop("shard", "depth", "doc_bytes", "shard_bytes", "global_depth")
    # The row is carried in one column, so that no name in it can clash.
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = docs.select(F.struct(*docs.columns).alias("_row"), hashed(docs["doc_id"]).alias("_h"), size.alias("doc_bytes"))
    found = directory(docs.select(hashed(docs["doc_id"]).alias("_h"), size.alias("_bytes")), limit)
    names = ("_depth", "_prefix", "_shard_bytes")
    for k, (bits, table, rows) in enumerate(found):
        out = out.withColumn(f"_cell_{k}", prefix("_h", bits))
        out = out.join(size_checked(table.select(F.col("_cell").alias(f"_cell_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in names)), rows), f"_cell_{k}", "left")
    pick = lambda c: F.coalesce(*(F.col(f"{c}_{k}") for k in range(len(found))))
    deepest = max((r[0] or 0) for r in (t.agg(F.max("_depth")).first() for _, t, _ in found))
    out = out.select("_row", "_h", "doc_bytes", pick("_depth").alias("depth"), pick("_prefix").alias("_prefix"), pick("_shard_bytes").alias("shard_bytes"))
    named = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("_prefix"), F.col("depth"), F.lit("0")))
    last_bits, last, _ = found[-1]
    columns = ["_row", "shard", "depth", "doc_bytes", "shard_bytes"]
    if last_bits == HASH_BITS and last.filter("_depth is null").take(1):
        deepest = HASH_BITS
        over = checkpoint(out.filter("depth is null")).withColumns({"depth": F.lit(HASH_BITS), "_part": F.spark_partition_id()})
        small = F.col("doc_bytes") * 2 <= limit
        w = Window.partitionBy("_h", "_part").orderBy("doc_bytes")
        start = F.sum(F.when(small, F.col("doc_bytes")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("doc_bytes")
        page = F.when(small, F.floor(start / max(1, limit // 2))).otherwise(F.row_number().over(w) + F.lit(1 << 40))
        over = over.withColumn("_page", page).withColumn("shard", F.concat_ws(".", F.lpad(F.bin("_h"), HASH_BITS, "0"), F.col("_part").cast("string"), F.col("_page").cast("string")))
        over = over.withColumn("shard_bytes", F.sum("doc_bytes").over(Window.partitionBy("_h", "_part", "_page")))
        out = out.filter("depth is not null").withColumn("shard", named).select(*columns).unionByName(over.select(*columns))
    else:
        out = out.withColumn("shard", named)
    return out.select("_row.*", "shard", F.col("depth").cast("int").alias("depth"), "doc_bytes", F.col("shard_bytes").cast("long").alias("shard_bytes"), F.lit(int(deepest)).alias("global_depth"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards of 16 MiB of text at most over all documents."""
    from plumbline.llm.common import documents

    return shard(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


SQL = f"""
with d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h,
    coalesce(strlen(text), 0)::bigint as doc_bytes from documents),
l as (select *, unnest(range(0, 21)) as depth from d),
s as (select depth, h >> (60 - depth) as prefix, sum(doc_bytes) as shard_bytes, count(*) as n from l group by all),
b as (select doc_id, min(s.depth) as depth from l join s on s.depth = l.depth and s.prefix = l.h >> (60 - l.depth)
    where s.shard_bytes <= {MAX_SHARD_BYTES} or n = 1 group by doc_id)
select d.doc_id, case when b.depth = 0 then '' else right(lpad(bin(h >> (60 - b.depth)), 60, '0'), b.depth::int) end as shard, b.depth::int as depth,
    doc_bytes, s.shard_bytes::bigint as shard_bytes, (select max(depth) from b)::int as global_depth
from d join b using (doc_id) join s on s.depth = b.depth and s.prefix = h >> (60 - b.depth)"""
