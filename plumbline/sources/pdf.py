"""Geometry of PDF pages: boxes as exact decimals and rotation, by page number.

A file is read as its cross-references say: tables and streams, updates included, objects in object
streams, and the page tree with what its nodes inherit. A file that can't be read so has one row with the
problem. Content streams are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0:decimal(24,12),y0:decimal(24,12),x1:decimal(24,12),y1:decimal(24,12)>"
#: Pages of a file, nested values in an object, and bytes of a cross-reference or object stream at most.
MOST_PAGES, MOST_DEPTH, MOST_BYTES = 100_000, 100, 64 << 20
SPACE, TOKEN = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*"), re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")


class Unreadable(ValueError):
    pass


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    head: dict
    start: int


class Values:
    """Reads values one after another from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = SPACE.match(self.data, self.at).end()

    def word(self) -> bytes:
        self.skip()
        m = TOKEN.match(self.data, self.at)
        if not m:
            raise Unreadable(f"no word at byte {self.at}")
        self.at = m.end()
        return m[0]

    def value(self, depth: int = 0):
        """A number, Ref, name (str with its slash), string (bytes), list, dict, bool or None."""
        if depth > MOST_DEPTH:
            raise Unreadable("values nested too deep")
        self.skip()
        data, at = self.data, self.at
        if data.startswith(b"<<", at):
            self.at += 2
            out = {}
            while not self.ends(b">>"):
                key = self.value(depth + 1)
                out[key if isinstance(key, str) else str(key)] = self.value(depth + 1)
            return out
        if data.startswith(b"[", at):
            self.at += 1
            out = []
            while not self.ends(b"]"):
                out.append(self.value(depth + 1))
            return out
        if data.startswith(b"/", at):
            m = TOKEN.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return "/" + re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), (m[0] if m else b"").decode("latin-1"))
        if data.startswith(b"(", at):
            level, k = 0, at
            while k < len(data):
                level += {40: 1, 41: -1}.get(data[k], 0)
                if not level:
                    break
                k += 2 if data[k] == 92 else 1
            self.at = k + 1
            return data[at + 1 : k]
        if data.startswith(b"<", at):
            end = data.find(b">", at)
            if end < 0:
                raise Unreadable("a string without an end")
            self.at = end + 1
            return data[at + 1 : end]
        word = self.word()
        if NUMBER.fullmatch(word):
            back = self.at
            if word.isdigit() and (m := re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(data, back)):
                self.at = m.end()
                return Ref(int(word), int(m[1]))
            return Decimal(word.decode())
        if word in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[word]
        raise Unreadable(f"no value at byte {at}")

    def ends(self, mark: bytes) -> bool:
        self.skip()
        if self.at >= len(self.data):
            raise Unreadable("the file ends in a value")
        if self.data.startswith(mark, self.at):
            self.at += len(mark)
            return True
        return False


def whole(x) -> int:
    if not isinstance(x, Decimal) or x != int(x):
        raise Unreadable("a number that isn't whole")
    return int(x)


class File:
    def __init__(self, data: bytes):
        self.data, self.where, self.trailer = data, {}, {}
        self.held: dict[int, object] = {}
        self.packed: dict[int, dict[int, object]] = {}
        at, seen = data.rfind(b"startxref"), set()
        if b"%PDF-" not in data[:1024] or at < 0:
            raise Unreadable("not a PDF")
        waiting = [whole(Values(data, at + 9).value())]
        while waiting:
            start = waiting.pop(0)
            if start in seen or not 0 <= start < len(data):
                raise Unreadable("cross-references that lead nowhere or back")
            seen.add(start)
            head = self.section(start)
            self.trailer = {**head, **self.trailer}
            waiting += [whole(head[k]) for k in ("/XRefStm", "/Prev") if k in head]

    def section(self, start: int) -> dict:
        """Reads a table or stream of cross-references; what is known already stays. Its trailer."""
        v = Values(self.data, start)
        v.skip()
        if not self.data.startswith(b"xref", v.at):
            return self.stream_section(start)
        v.at += 4
        while True:
            word = v.word()
            if word == b"trailer":
                head = v.value()
                if not isinstance(head, dict):
                    raise Unreadable("no trailer")
                return head
            first, n = int(word), int(v.word())
            for k in range(first, first + n):
                place, generation, kind = int(v.word()), int(v.word()), v.word()
                self.where.setdefault(k, ("at", place, generation) if kind == b"n" else None)

    def stream_section(self, start: int) -> dict:
        found = self.parsed(start)[1]
        if not isinstance(found, Stream) or found.head.get("/Type") != "/XRef":
            raise Unreadable("no cross-references")
        head, body = found.head, self.decoded(found)
        widths = [whole(x) for x in head["/W"]]
        index = [whole(x) for x in head.get("/Index", [Decimal(0), head["/Size"]])]
        at = 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for k in range(first, first + n):
                row = []
                for w in widths:
                    row.append(int.from_bytes(body[at : at + w]) if w else None)
                    at += w
                kind = 1 if row[0] is None else row[0]
                self.where.setdefault(k, ("at", row[1], row[2] or 0) if kind == 1 else ("in", row[1], row[2]) if kind == 2 else None)
        return head

    def parsed(self, start: int) -> tuple[int, object]:
        """(number, value) of the object at a place."""
        v = Values(self.data, start)
        number, _, word = int(v.word()), int(v.word()), v.word()
        if word != b"obj":
            raise Unreadable(f"no object at byte {start}")
        value = v.value()
        v.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", v.at):
            at = v.at + 6
            at += 2 if self.data.startswith(b"\r\n", at) else 1
            return number, Stream(value, at)
        return number, value

    def decoded(self, s: Stream) -> bytes:
        """A stream's bytes: plain, or deflated with or without PNG prediction."""
        n = whole(self.of(s.head.get("/Length")))
        raw, kind = self.data[s.start : s.start + n], self.of(s.head.get("/Filter"))
        kind, parms = (x[0] if isinstance(x, list) and len(x) == 1 else x for x in (kind, self.of(s.head.get("/DecodeParms"))))
        if kind is None:
            return raw
        if kind != "/FlateDecode":
            raise Unreadable(f"filter {kind}")
        out = zlib.decompressobj()
        try:
            body = out.decompress(raw, MOST_BYTES)
        except zlib.error as e:
            raise Unreadable("a stream that can't be inflated") from e
        if out.unconsumed_tail:
            raise Unreadable("a stream that is too large")
        parms = self.of(parms) or {}
        if whole(parms.get("/Predictor", Decimal(1))) < 10:
            return body
        width = whole(parms.get("/Columns", Decimal(1)))
        rows, above = [], bytearray(width)
        for at in range(0, len(body), width + 1):
            how, row = body[at], bytearray(body[at + 1 : at + 1 + width])
            for k in range(len(row)):
                left, up, corner = row[k - 1] if k else 0, above[k], above[k - 1] if k else 0
                guess = left + up - corner
                nearest = min((left, up, corner), key=lambda x: abs(guess - x))
                row[k] = (row[k] + (0, left, up, (left + up) // 2, nearest)[how]) & 255 if how < 5 else row[k]
            rows.append(bytes(row))
            above = row
        return b"".join(rows)

    def of(self, x, steps: int = 0):
        """A value with references followed."""
        if not isinstance(x, Ref):
            return x
        if steps > MOST_DEPTH:
            raise Unreadable("references in a ring")
        if x.number not in self.held:
            where = self.where.get(x.number)
            if where is None:
                value = None
            elif where[0] == "at":
                number, value = self.parsed(where[1])
                if number != x.number or where[2] != x.generation:
                    raise Unreadable(f"object {x.number} isn't where it should be")
            else:
                value = self.inside(where[1]).get(x.number)
            self.held[x.number] = value
        return self.of(self.held[x.number], steps + 1)

    def inside(self, number: int) -> dict[int, object]:
        """The objects of an object stream."""
        if number not in self.packed:
            where = self.where.get(number)
            s = self.parsed(where[1])[1] if where and where[0] == "at" else None
            if not isinstance(s, Stream):
                raise Unreadable("no object stream")
            body, first = self.decoded(s), whole(self.of(s.head.get("/First")))
            v = Values(body)
            places = [(int(v.word()), int(v.word())) for _ in range(whole(self.of(s.head.get("/N"))))]
            self.packed[number] = {n: Values(body, first + at).value() for n, at in places}
        return self.packed[number]

    def box(self, x) -> tuple[Decimal, ...] | None:
        x = self.of(x)
        if x is None:
            return None
        x = [self.of(v) for v in x] if isinstance(x, list) else []
        if len(x) != 4 or not all(isinstance(v, Decimal) for v in x):
            raise Unreadable("a box that isn't four numbers")
        return tuple(x)

    def pages(self) -> Iterator[tuple]:
        """(media box, crop box as given or the media box, rotation) of each page in order."""
        root = self.of(self.trailer.get("/Root"))
        if not isinstance(root, dict):
            raise Unreadable("no root")
        waiting, seen, n = [(root.get("/Pages"), {})], set(), 0
        while waiting:
            ref, above = waiting.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    raise Unreadable("a page tree with a ring")
                seen.add(ref)
            node = self.of(ref)
            if not isinstance(node, dict):
                raise Unreadable("a page that isn't there")
            mine = above | {k: node[k] for k in ("/MediaBox", "/CropBox", "/Rotate") if k in node}
            if "/Kids" in node:
                kids = self.of(node["/Kids"])
                waiting.extend((kid, mine) for kid in reversed(kids if isinstance(kids, list) else []))
                continue
            n += 1
            media, rotate = self.box(mine.get("/MediaBox")), self.of(mine.get("/Rotate", Decimal(0)))
            if media is None or n > MOST_PAGES:
                raise Unreadable("a page without a box" if media is None else "too many pages")
            yield media, self.box(mine.get("/CropBox")) or media, whole(rotate) % 360


def geometry(content: bytes | None) -> list[tuple]:
    """(page, media, crop, rotation, problem) rows."""
    try:
        return [(n, *page, None) for n, page in enumerate(File(content or b"").pages(), 1)]
    except (Unreadable, ValueError, KeyError, IndexError, TypeError, ArithmeticError, RecursionError) as e:
        return [(None, None, None, None, str(e) if isinstance(e, Unreadable) else "malformed")]


def pages(files: DataFrame, key: str = "file") -> DataFrame:
    """key, page (from 1), media_box and crop_box (the effective one) as exact decimals, rotation, problem of files (key, content)."""

    def read(batches):
        names = ("x0", "y0", "x1", "y1")
        struct = lambda box: None if box is None else dict(zip(names, box, strict=True))
        for batch in batches:
            rows = [(k, n, struct(media), struct(crop), turn, problem) for k, content in zip(batch[key], batch["content"], strict=True) for n, media, crop, turn, problem in geometry(None if content is None else bytes(content))]
            yield pd.DataFrame(rows, columns=[key, "page", "media_box", "crop_box", "rotation", "problem"]).astype({"page": "Int32", "rotation": "Int32"})

    return files.select(key, "content").mapInPandas(read, f"{key} {dict(files.dtypes)[key]}, page int, media_box {BOX}, crop_box {BOX}, rotation int, problem string")


def problems(found: DataFrame, count: int, width: str, height: str, key: str = "file") -> DataFrame:
    """key, page, problem of pages() that aren't `count` unrotated pages from (0, 0) to (width, height)."""
    right = lambda box: (F.col(f"{box}.x0") == 0) & (F.col(f"{box}.y0") == 0) & (F.col(f"{box}.x1") == F.lit(width).cast("decimal(24,12)")) & (F.col(f"{box}.y1") == F.lit(height).cast("decimal(24,12)"))
    why = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("rotation") != 0, "rotated").when(~right("media_box"), "media box").when(~right("crop_box"), "crop box")
    each = found.withColumn("problem", why).filter("problem is not null").select(key, "page", "problem")
    n = found.groupBy(key).agg(F.count("page").alias("n"), F.count("problem").alias("bad")).filter((F.col("n") != count) & (F.col("bad") == 0))
    return each.unionByName(n.select(key, F.lit(None).cast("int").alias("page"), F.concat(F.col("n").cast("string"), F.lit(" pages")).alias("problem")))
