import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, warc

ROWS = [(1, "http://a/1", "<p>same ä</p>"), (2, "http://a/2", "<p>same ä</p>"), (2, "http://a/2", "<p>same ä</p>"), (None, "http://a/3", "<p>same ä</p>"), (3, None, "one\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (4, "http://a/x y\r\nEvil: 1", None), (5, "http://a/5%", ""), (6, "u", "x" * 300_000), (None, None, "no id")]
SCHEMA = "page_id long, url string, html string"


def pages(spark, rows=ROWS):
    wide = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("key", "mark", "size", "sha1", "keep", "name", "bytes")))
    return wide.repartition(3)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("hot", [1, 10_000])
def test_rows_as_by_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    warc.archive(pages(spark), f"{tmp_path}/a")
    got = sorted(map(str, (tuple(r) for r in warc.described(spark, f"{tmp_path}/a").select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    want, groups = [], {}
    for i, _, t in ROWS:
        groups.setdefault((t or "").encode(), []).append(i)
    for data, ids in groups.items():
        ids.sort(key=lambda i: -1 if i is None else i)
        want += [(i, len(data), digest(data), "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(data), digest(data), "response", None)]
    assert got == sorted(map(str, want))


def test_small_payloads_are_all_responses(spark, tmp_path):
    warc.archive(pages(spark, [(k, "u", "small" if k < 4 else "long enough") for k in range(8)]), f"{tmp_path}/a", least=6)
    got = {r.key: (r.record_type, r.refers_to) for r in warc.described(spark, f"{tmp_path}/a").collect()}
    assert got == {k: ("response", None) for k in (0, 1, 2, 3, 7)} | {k: ("revisit", 7) for k in (4, 5, 6)}
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 2  # every payload once


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_files_give_back_every_byte(spark, tmp_path, compression):
    warc.archive(pages(spark), f"{tmp_path}/a")
    warc.export(spark, f"{tmp_path}/a", f"{tmp_path}/files", compression, per_file=2)
    read = warc.read_warc(spark, f"{tmp_path}/files")
    records = {bytes(r.record) for r in warc.restore(spark, f"{tmp_path}/a").collect()}
    assert {bytes(r.header) + bytes(r.bytes) + b"\r\n\r\n" for r in read.collect()} == records and read.count() == len(ROWS)
    assert sum(b"Evil" in bytes(r.header).split(b"\r\nEvil")[0] for r in read.collect()) == 1  # the line end was encoded
    warc.ingest(read, f"{tmp_path}/b")
    assert {bytes(r.record) for r in warc.restore(spark, f"{tmp_path}/b").collect()} == records


def test_bytes_that_are_no_text(spark, tmp_path):
    raw = bytes(range(256)) * 9
    wide = spark.createDataFrame([(1, "u", bytearray(raw)), (2, "u", bytearray(b"\r\n\r\n"))], "page_id long, url string, html binary")
    warc.archive(wide, f"{tmp_path}/a")
    warc.export(spark, f"{tmp_path}/a", f"{tmp_path}/f")
    assert sorted(bytes(r.bytes) for r in warc.read_warc(spark, f"{tmp_path}/f").collect()) == sorted([raw, b"\r\n\r\n"])


def test_members_of_their_own_and_cut_files():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [x[1:] for x in warc.split_warc(gzip.compress(one) + gzip.compress(one))] == [("warcinfo", one[:-8], b"abcd")] * 2
    for bad in (one[:-9], b"HTTP" + one, one + b"x"):
        with pytest.raises(ValueError, match="no whole WARC record"):
            list(warc.split_warc(bad))


def test_a_changed_payload_is_noticed(spark, tmp_path):
    warc.archive(pages(spark), f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("bytes", F.lit(b"other")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="not what its name says"):
        warc.restore(spark, f"{tmp_path}/b").collect()


def test_empty(spark, tmp_path):
    warc.archive(pages(spark, []), f"{tmp_path}/a")
    assert warc.described(spark, f"{tmp_path}/a").count() == 0 and warc.restore(spark, f"{tmp_path}/a").count() == 0
