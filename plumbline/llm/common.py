"""Helpers that the corpus operators share."""

from __future__ import annotations

import string
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut as checkpoint
from plumbline.functions.lineage import shared_folder

__all__ = ["checkpoint", "shared_folder"]

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Runs of anything but the six ASCII white-space characters.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table: A-Z lowered, everything but 0-9, a-z and non-ASCII bytes to a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: bytes.translate table that lowers A-Z only.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Arrow batches are cut into slices of about so many bytes of text.
SLICE_BYTES = 4 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null stays null."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id, modulus: int) -> int:
    """crc32 of the id as text, null as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def crc_mod_column(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple:
    """(data, offsets) of a string or binary column as numpy arrays without a copy; nulls are empty."""
    import numpy as np

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int | None = None):
    """Consecutive parts of a batch with about `limit` bytes of text and at most `rows` rows each, one row at least.

    Who makes as much of a short text as of a long one must name rows: a batch may hold 10 000 short texts.
    """
    import numpy as np

    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, at + rows) if rows else to
        yield batch.slice(at, to - at)
        at = to


def size_checked(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Broadcasts a table that was counted to have few rows; a larger one is shuffled."""
    return F.broadcast(df) if rows <= most else df


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of docs has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key beyond which a table's rows with it are joined by broadcast.
HOT = 10_000


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left-joined with a table of one row for each key and the number of rows with it (size).

    Keys of over HOT rows, of which there are at most rows / HOT, are broadcast: no task gets all
    rows of one. rows and table are read twice then and should be checkpoints.
    """
    often = table.filter(F.col("size") > HOT)
    if not often.take(1):
        return rows.join(table, key, "left")
    marked = rows.join(F.broadcast(often.select(key, F.lit(True).alias("_often"))), key, "left")
    mine = marked.filter("_often").drop("_often").join(F.broadcast(often), key)
    rest = marked.filter("_often is null").drop("_often").join(table.filter(F.col("size") <= HOT), key, "left")
    return rest.unionByName(mine)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.sources import load

    return load(spark, sf_dir, "documents")
