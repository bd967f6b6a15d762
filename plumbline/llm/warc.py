"""A content-addressed archive of WARC records.

An archive is a folder of two Parquet tables. `payloads` holds the bytes of every distinct payload
once, named by their SHA-256, length and SHA-1. `records` holds the exact header bytes of every
record apart from them, and the name of its payload. A record as it was is header, payload (none for
a revisit) and the two line ends after it: restore() joins them, and reads no payload whose bytes
don't have the digest that they are named by. Payloads that agree in SHA-256 but not in length and
SHA-1 are different payloads.

archive() decides which records are responses: of equal payloads of `least` bytes or more the record
with the largest key (null is below any; of rows that repeat it, one), the others are revisits that
refer to it; smaller payloads are all responses. export() writes real .warc files, read_warc() reads
such files, ingest() archives what was read, byte for byte.

Null payloads are empty. A null URL is named by the key; line ends, blanks and other control
characters in URLs are percent-encoded, so that no header can be broken. Repeated rows are records of
their own, empty tables give empty archives, other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint, join_hot, shared_folder, size_checked

#: Fixed values of the formats: RFC 4648 alphabet, WARC 1.1 names.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Repeated payloads whose names are looked up by broadcast at most; with more they are shuffled.
FEW_REPEATED = 500_000
#: Records in a .warc file at most; it is read by one task.
RECORDS_PER_FILE = 2_000
NAME = ["sha256", "length", "sha1"]


def base32(digest: Column) -> Column:
    """Base32 of a SHA-1 given as 40 hex digits: five of them are four letters."""
    letters = []
    for k in range(1, 41, 5):
        five = F.conv(F.substring(digest, k, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(five, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for bits in (15, 10, 5, 0)]
    return F.concat(*letters)


def names(payload: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(payload, 256), "length": F.octet_length(payload).cast("long"), "sha1": F.sha1(payload)}


def lines(*fields: tuple[str, Column | str]) -> Column:
    """`name: value` lines; those with a null value are left out."""
    return F.concat_ws("\r\n", *(F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v.cast("string")) for k, v in fields))


def safe_url(url: Column, key: Column) -> Column:
    bad = F.regexp_replace(F.regexp_replace(url, r"%(?![0-9A-Fa-f]{2})", "%25"), r"[\x00-\x20\x7F]", "%20")
    return F.coalesce(bad, F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("none"))))


def record_id(key: Column, mark: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), mark.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def http_header(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\n"), lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", length)), F.lit(END))


def headed(rows: DataFrame, date: str) -> DataFrame:
    """Adds header, the record's bytes before its payload, to key, mark, url, names, record_type and keep."""
    http = http_header(F.col("length"))
    revisit, response = F.col("record_type") == "revisit", F.col("record_type") == "response"
    body = F.octet_length(http) + F.when(response, F.col("length")).otherwise(0)
    fields = lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", record_id(F.col("key"), F.col("mark"))),
        ("WARC-Date", date),
        ("WARC-Target-URI", safe_url(F.col("url"), F.col("key"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("keep.key"), F.col("keep.mark")))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", body),
    )
    return rows.withColumn("header", F.concat(F.lit("WARC/1.1\r\n"), fields, F.lit(END), http).cast("binary"))


def store(payloads: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """One row for each named payload (bytes). Names that occur once need no shuffle; equal payloads of a
    task meet before they are sent."""
    if not n:
        return payloads.select(*NAME, "bytes")
    marked = payloads.join(size_checked(repeated.select(*NAME, F.lit(True).alias("again")), n, FEW_REPEATED), NAME, "left")
    once = marked.filter("again is null").select(*NAME, "bytes")
    return once.unionByName(marked.filter("again").groupBy(*NAME).agg(F.any_value("bytes").alias("bytes")))


def archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes pages as an archive, one record for each row."""
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    slim = checkpoint(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), *(c.alias(k) for k, c in names(content).items())).withColumn("mark", F.monotonically_increasing_id()))
    groups = slim.groupBy(*NAME).agg(F.max(F.struct("key", "mark")).alias("keep"), F.count(F.lit(1)).alias("size"))
    repeated = checkpoint(groups.filter("size > 1").withColumn("name", F.concat_ws(":", *NAME)))
    met = join_hot(slim.withColumn("name", F.concat_ws(":", *NAME)), repeated.select("name", "keep", "size"), "name").drop("name")
    revisit = (F.col("length") >= least) & (F.col("mark") != F.col("keep.mark"))
    rows = met.withColumn("record_type", F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response"))
    rows = headed(rows, date).withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("keep.key")))
    rows.select(F.struct("key", "mark").alias("id"), "record_type", "refers_to", "header", *NAME, (F.col("record_type") == "response").alias("carries")).write.parquet(f"{folder}/records")
    bytes_of = pages.select(content.alias("bytes"))
    store(bytes_of.select("bytes", *(c.alias(k) for k, c in names(F.col("bytes")).items())), repeated, repeated.count()).write.parquet(f"{folder}/payloads")


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records and payloads of an archive; a payload that doesn't have its digests ends the job when read."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    right = (F.sha2("bytes", 256) == F.col("sha256")) & (F.octet_length("bytes") == F.col("length")) & (F.sha1("bytes") == F.col("sha1"))
    broken = F.raise_error(F.concat(F.lit("payload is not what its name says: "), "sha256")).cast("binary")
    return spark.read.parquet(f"{folder}/records"), payloads.withColumn("bytes", F.when(right, F.col("bytes")).otherwise(broken))


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive as they were written: id, record_type, refers_to, header, names and record
    (all bytes). A payload meets the records that carry it; revisits of archive() carry none."""
    records, payloads = stored(spark, folder)
    carry = records.filter("carries").join(payloads, NAME)
    end = F.lit(END).cast("binary")
    whole = carry.select(*records.columns, F.concat("header", "bytes", end).alias("record"))
    return whole.unionByName(records.filter("not carries").select(*records.columns, F.concat("header", end).alias("record")))


def export(spark: SparkSession, folder: str, out: str, compression: str = "gzip", per_file: int = RECORDS_PER_FILE) -> None:
    """Writes an archive as .warc files. The text writer's line separator is the record's end."""
    records = restore(spark, folder).select(F.substring("record", F.lit(1), F.octet_length("record") - len(END)).cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", per_file).text(out)


LENGTH, TYPE = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.I), re.compile(rb"\r\nWARC-Type:[ \t]*(\w+)", re.I)


def split_warc(data: bytes):
    """(place, record_type, header, payload) of each record of a WARC file's bytes, gzipped or not. The HTTP header of
    a response belongs to the header. A record that isn't whole ends the file with a ValueError."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        head = data.find(END.encode(), at)
        length = LENGTH.search(data, at, head + 4) if head > 0 else None
        if data[at : at + 5] != b"WARC/" or not length or head + 8 + int(length[1]) > len(data):
            raise ValueError(f"no whole WARC record at byte {at}")
        kind = TYPE.search(data, at, head + 4)
        start, end = head + 4, head + 4 + int(length[1])
        inner = data.find(END.encode(), start, end) if data[start : start + 5] == b"HTTP/" else -1
        cut = inner + 4 if inner >= 0 else start
        yield at, kind[1].decode().lower() if kind else None, data[at:cut], data[cut:end]
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, place (byte in the uncompressed file), record_type, header and bytes of every record of WARC files."""

    def split(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held, size = [], 0
                for row in split_warc(content.as_py()):
                    held.append((path, *row))
                    size += len(row[3])
                    if size > 8 << 20:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    def packed(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "place", "record_type", "header", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc,gz}").load(path).select("path", "content")
    return files.mapInArrow(split, "path string, place long, record_type string, header binary, bytes binary")


def ingest(records: DataFrame, folder: str) -> None:
    """Archives records of read_warc() with their own headers: every payload once, every header exactly."""
    named = records.select(F.struct("path", "place").alias("id"), F.col("record_type"), F.lit(None).cast("string").alias("refers_to"), "header", "bytes", *(c.alias(k) for k, c in names(F.col("bytes")).items()))
    named.drop("bytes").withColumn("carries", F.lit(True)).write.parquet(f"{folder}/records")
    repeated = checkpoint(named.groupBy(*NAME).count().filter("count > 1").select(*NAME))
    store(named.select("bytes", *NAME), repeated, repeated.count()).write.parquet(f"{folder}/payloads")


def described(spark: SparkSession, folder: str) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to of every record, from the bytes read back.

    A response's are those of its restored record after the header. A revisit's are those of the response
    that carries its payload.
    """
    restored = restore(spark, folder)
    body = F.substring("record", F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - len(END))
    found = checkpoint(restored.filter("record_type = 'response'").select("id.key", *NAME, F.octet_length(body).cast("long").alias("payload_bytes"), base32(F.sha1(body)).alias("payload_digest")))
    name = F.concat_ws(":", *NAME)
    revisits = checkpoint(spark.read.parquet(f"{folder}/records").filter("record_type = 'revisit'").select("id.key", "refers_to", name.alias("name")))
    sizes = revisits.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    carried = checkpoint(found.withColumn("name", name).join(sizes, "name").groupBy("name").agg(*(F.any_value(c).alias(c) for c in ("payload_bytes", "payload_digest", "size"))))
    again = join_hot(revisits, carried, "name").select("key", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    first = found.select("key", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"))
    return first.unionByName(again, allowMissingColumns=True)


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Archives all pages in the shared folder and reads the records back."""
    from plumbline.sources import load

    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archive(load(spark, sf_dir, "pages"), folder)
    return described(spark, folder).withColumnRenamed("key", "page_id")


_FIVES = ", ".join(f"('0x' || substr(h, {k}, 5))::int" for k in range(1, 41, 5))
SQL = f"""
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select *, sha1(t) as h, row_number() over (partition by t order by page_id desc nulls last) as k, max(page_id) over (partition by t) as top from p)
select page_id, strlen(t)::bigint as payload_bytes,
    list_aggregate(list_transform([{_FIVES}], lambda x: substr('{BASE32}', (x >> 15) % 32 + 1, 1) || substr('{BASE32}', (x >> 10) % 32 + 1, 1)
        || substr('{BASE32}', (x >> 5) % 32 + 1, 1) || substr('{BASE32}', x % 32 + 1, 1)), 'string_agg', '') as payload_digest,
    case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then top end as refers_to
from d"""
