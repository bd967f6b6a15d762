"""Other sources: multi-document files, JSON, Markdown, folders, tar files, images, PDF boxes."""

from __future__ import annotations

import io
import tarfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.text import strip_unicode


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole-file JSON documents; anything that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def multi_documents(spark: SparkSession, path: str, schema: str, ordinal: str = "item") -> DataFrame:
    """JSON documents (or arrays of them) that lines of --- separate, as rows in file order."""
    t = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), "value")
    d = t.select("file", F.posexplode(F.split("value", r"(?m)^---[ \t]*$\n?")).alias("document", "text")).filter("trim(text) <> ''")
    text = F.when(F.ltrim("text").startswith("["), F.trim("text")).otherwise(F.concat(F.lit("["), F.trim("text"), F.lit("]")))
    rows = d.select("file", "document", F.posexplode(F.from_json(text, f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias(ordinal, "r"))
    return rows.select("file", "document", ordinal, "r.*")


def strict_json(df: DataFrame, column: str, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Parses a column; problem names the first of: not JSON, missing keys, unknown keys."""
    have = F.json_object_keys(column)
    need = F.array(*(F.lit(k) for k in keys))
    problem = F.when(have.isNull(), "not an object").when(F.size(F.array_except(need, have)) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(F.array_except(need, have)), ","))).when(F.size(F.array_except(have, need)) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(F.array_except(have, need)), ",")))
    return df.withColumn("problem", problem).withColumn("parsed", F.when(F.col("problem").isNull(), F.from_json(column, schema)))


def json_header(text):
    """The JSON object in a leading comment of a Markdown text, else null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\A<!--\s*(\{.*?\})\s*-->", 1), F.lit(""))


def sections(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """`### SLIDE n: title` sections: keys, slide, title, body."""
    s = df.select(*key, F.explode(F.split(text, r"(?m)(?=^### SLIDE \d+:)")).alias("s")).filter(F.col("s").rlike(r"^### SLIDE \d+:"))
    return s.select(*key, F.regexp_extract("s", r"^### SLIDE (\d+):", 1).cast("int").alias("slide"), F.regexp_extract("s", r"^### SLIDE \d+:[ \t]*([^\n]*)", 1).alias("title"), strip_unicode(F.regexp_replace("s", r"^[^\n]*\n?", "")).alias("body"))


def tree(spark: SparkSession, path: str, exclude: str = r"(^|/)(\.git|__pycache__)(/|$)") -> DataFrame:
    """path (relative), length, sha256 of every file below, without excluded ones."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/") + "/"
    rel = F.expr(f"substring(path, locate('{root}', path) + {len(root)})")
    return f.select(rel.alias("path"), "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256")).filter(~F.col("path").rlike(exclude))


def tar_members(df: DataFrame) -> DataFrame:
    """Members of tar files (archive, content): path, length, executable, sha256, problem.

    A tar file that can't be read, or not to its end, has a row without a path for that; its members up
    to there have theirs. A name that comes again is a problem of its later members.
    """
    import hashlib

    def listed(name, content):
        seen: set[str] = set()
        try:
            with tarfile.open(fileobj=io.BytesIO(content or b"")) as t:
                for m in t:
                    if m.isdir():
                        continue
                    bad = "not a file" if not m.isfile() else "leaves the archive" if m.name.startswith("/") or ".." in m.name.split("/") else "repeated name" if m.name in seen else None
                    seen.add(m.name)
                    body = t.extractfile(m).read() if m.isfile() else b""
                    yield name, m.name, m.size, bool(m.mode & 0o111), f"sha256:{hashlib.sha256(body).hexdigest()}", bad
        except (tarfile.TarError, zlib.error, EOFError, OSError, ValueError):
            yield name, None, None, None, None, "unreadable"

    def read(batches):
        for batch in batches:
            rows = [row for name, content in zip(batch["archive"], batch["content"], strict=True) for row in listed(name, content)]
            yield pd.DataFrame(rows, columns=["archive", "path", "length", "executable", "sha256", "problem"])

    return df.select("archive", "content").mapInPandas(read, "archive string, path string, length long, executable boolean, sha256 string, problem string")


def images(spark: SparkSession, path: str) -> DataFrame:
    """slide (from the name slide-N.png), width and height of the PNG header."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "slide-*.png").option("recursiveFileLookup", "true").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return f.select(F.regexp_extract("path", r"slide-(\d+)\.png$", 1).cast("int").alias("slide"), F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"), "content")


def pdf_boxes(df: DataFrame, content: str = "content") -> DataFrame:
    """MediaBox and CropBox of PDF pages as exact decimals (uncompressed page objects)."""
    t = F.decode(content, "ISO-8859-1")
    boxes = F.regexp_extract_all(t, F.lit(r"/(?:Media|Crop)Box\s*\[\s*[-\d.\s]+\]"), F.lit(0))
    b = df.select(*[c for c in df.columns if c != content], F.posexplode(boxes).alias("ordinal", "box"))
    n = F.regexp_extract_all("box", F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return b.select(*[c for c in b.columns if c != "box"], F.regexp_extract("box", r"/(Media|Crop)Box", 1).alias("kind"), (n[2].cast("decimal(24,12)") - n[0].cast("decimal(24,12)")).alias("width"), (n[3].cast("decimal(24,12)") - n[1].cast("decimal(24,12)")).alias("height"))


def uploads(spark: SparkSession, path: str, most: int = 100 << 20):
    """A stream of uploaded files with size limit, magic bytes and hash."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    verdict = F.when(F.col("length") > most, "too large").when(F.hex(F.substring("content", 1, 4)) != "504B0304", "not a package").otherwise("ok")
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), verdict.alias("verdict"))
