"""What makes a package unsafe to read, found from its directory before anything is inflated.

A verdict is the first problem in order of cost: the container, its directory (number, names and
sizes of members), then the few members whose content matters. Members are read only after the
declared sizes are known to be within the limits.
"""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Suffixes and content types that are refused, and marks of file formats.
ARCHIVES = (".zip", ".pptx", ".docx", ".xlsx", ".jar", ".7z", ".rar")
EXECUTABLES = (".exe", ".dll", ".com", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".jar", ".msi", ".scr", ".sh", ".py", ".app", ".dylib", ".so")
ACTIVE_TYPES = (b"macroEnabled", b"application/vnd.ms-office.vbaProject", b"application/vnd.ms-office.activeX", b"application/vnd.openxmlformats-officedocument.oleObject")
SHEET_TYPE, WORKBOOK_TYPE = b"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", b"spreadsheetml.sheet.main+xml"
OLE = bytes.fromhex("D0CF11E0A1B11AE1")
EXTERNAL = re.compile(rb"""TargetMode\s*=\s*["']External["']""", re.I)
SLIDE = re.compile(r"ppt/slides/slide[1-9][0-9]*\.xml")
#: Members above this size aren't opened to look for OLE.
LARGEST_OLE = 25 << 20
BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, ValueError)


@dataclass(frozen=True)
class Limits:
    members: int = 10_000
    size: int = 500 << 20
    ratio: float = 20.0


def unsafe_name(name: str) -> str | None:
    if not name or name.startswith("/") or "\\" in name or "\0" in name or {"..", ".", ""} & set(name.rstrip("/").split("/")):
        return "unsafe name"
    return None if unicodedata.is_normalized("NFC", name) else "name not NFC"


def opened(content: bytes | None) -> zipfile.ZipFile | str:
    """The archive, or why it can't be opened."""
    if not content:
        return "empty"
    if not content.startswith(b"PK\x03\x04"):
        return "not a ZIP"
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except BROKEN:
        return "not a ZIP"


def weight_problem(infos: list[zipfile.ZipInfo], limits: Limits, members: int = 0, size: int = 0) -> str | None:
    """Too many or too large members by the directory alone; members and size: what counts already."""
    if len(infos) + members > limits.members:
        return "too many parts"
    total = sum(i.file_size for i in infos)
    if total + size > limits.size:
        return "too large"
    return "ratio too high" if total > limits.ratio * max(1, sum(i.compress_size for i in infos)) else None


def directory_problems(infos: list[zipfile.ZipInfo], required: tuple[str, ...]) -> Iterator[str]:
    names = [i.filename for i in infos]
    if not names:
        yield "no parts"
    if any(i.flag_bits & 1 for i in infos):
        yield "encrypted"
    yield from filter(None, map(unsafe_name, names))
    if len(set(names)) < len(names):
        yield "repeated name"
    for name in required:
        if name not in names:
            yield f"missing {name}"


def content_problems(z: zipfile.ZipFile, infos: list[zipfile.ZipInfo], root: str, archives: tuple[str, ...]) -> Iterator[str]:
    """Problems of members by suffix, place and content. root: the folder of the main part."""
    types = z.read("[Content_Types].xml")
    if any(t in types for t in ACTIVE_TYPES):
        yield "active content type"
    for i in infos:
        suffix = posixpath.splitext(i.filename)[1].lower()
        inside = i.filename.startswith(f"{root}/embeddings/")
        if suffix in EXECUTABLES:
            yield "executable"
        if suffix in archives and not inside:
            yield "nested archive"
        if i.filename.startswith(f"{root}/activeX/") or "vbaProject" in i.filename:
            yield "active content"
        if i.filename.endswith(".rels") and EXTERNAL.search(z.read(i)):
            yield "external relationship"
        if len(OLE) <= i.file_size <= LARGEST_OLE:
            with z.open(i) as part:
                if part.read(len(OLE)) == OLE:
                    yield "hidden OLE"


def workbook_problems(z: zipfile.ZipFile, limits: Limits) -> Iterator[str]:
    """Problems of a workbook behind a chart."""
    infos = z.infolist()
    yield from directory_problems(infos, ("[Content_Types].xml", "xl/workbook.xml"))
    if sum(i.file_size for i in infos) > limits.ratio * max(1, sum(i.compress_size for i in infos)):
        yield "ratio too high"
    if WORKBOOK_TYPE not in z.read("[Content_Types].xml"):
        yield "not a workbook"
    if any(i.filename.startswith("xl/embeddings/") for i in infos):
        yield "nested package"
    yield from content_problems(z, infos, "xl", ARCHIVES)


def package_problems(z: zipfile.ZipFile, limits: Limits, slides: int | None) -> Iterator[str]:
    infos = z.infolist()
    if len(infos) > limits.members:
        yield "too many parts"
    yield from directory_problems(infos, ("[Content_Types].xml", "ppt/presentation.xml"))
    if problem := weight_problem(infos, limits):
        yield problem
    members, size = len(infos), sum(i.file_size for i in infos)
    for i in infos:
        if not i.filename.startswith("ppt/embeddings/") or i.is_dir():
            continue
        inner = opened(z.read(i)) if i.filename.lower().endswith(".xlsx") and SHEET_TYPE in z.read("[Content_Types].xml") else "not a workbook"
        if isinstance(inner, str):
            yield f"embedded: {inner}"
            continue
        yield from (f"embedded: {p}" for p in workbook_problems(inner, limits))
        if problem := weight_problem(inner.infolist(), Limits(limits.members, limits.size, float("inf")), members, size):
            yield problem
        members, size = members + len(inner.infolist()), size + sum(x.file_size for x in inner.infolist())
    yield from content_problems(z, infos, "ppt", ARCHIVES)
    found = sum(bool(SLIDE.fullmatch(i.filename)) for i in infos)
    if slides is not None and found != slides:
        yield f"{found} slides"


def verdict(content: bytes | None, limits: Limits = Limits(), slides: int | None = None) -> str:
    """The first problem, or ok."""
    z = opened(content)
    if isinstance(z, str):
        return z
    try:
        return next(package_problems(z, limits, slides), "ok")
    except BROKEN:
        return "unreadable"


def safety(packages: DataFrame, limits: Limits = Limits(), slides: int | None = None) -> DataFrame:
    """package_id, safe, verdict of each package. slides: how many a tier asks for."""

    def read(batches):
        for batch in batches:
            found = [verdict(c if c is None else bytes(c), limits, slides) for c in batch["content"]]
            yield pd.DataFrame({"package_id": batch["package_id"], "safe": [v == "ok" for v in found], "verdict": found})

    return packages.select("package_id", "content").mapInPandas(read, "package_id string, safe boolean, verdict string")
