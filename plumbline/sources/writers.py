"""Binary writers: PNG of a raster, packages with fixed metadata."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.functions.arrow import amplified


def png(raster: np.ndarray) -> bytes:
    """8-bit grey (h x w) or RGB (h x w x 3)."""
    h, w = raster.shape[:2]
    rows = raster.reshape(h, -1).astype(np.uint8)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if raster.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 9)) + chunk(b"IEND", b"")


def difference_images(pairs: DataFrame, side: int) -> DataFrame:
    """pairs: key, a, b (byte arrays of side x side rasters). key, image: the amplified difference as PNG."""

    def draw(batches):
        for p in batches:
            made = [png(amplified(np.asarray(a, np.uint8).reshape(side, side), np.asarray(b, np.uint8).reshape(side, side))) for a, b in zip(p["a"], p["b"], strict=True)]
            yield pd.DataFrame({"key": p["key"], "image": made})

    return pairs.select("key", "a", "b").mapInPandas(draw, f"key {dict(pairs.dtypes)['key']}, image binary")


def renumbered(xml: bytes) -> bytes:
    """Axis ids of a chart in the order in which they are first seen, from 1."""
    seen: dict[bytes, int] = {}
    return re.sub(rb'((?:axId|crossAx) val=")(\d+)"', lambda m: m[1] + str(seen.setdefault(m[2], len(seen) + 1)).encode() + b'"', xml)


def resolved_packages(part: DataFrame, understood: frozenset[str] = frozenset()) -> DataFrame:
    """package_id, content: packages written anew, members by name, fixed times, compatibility markup
    resolved, chart axes renumbered. One package at a time."""
    from plumbline.sources.compatibility import resolve
    from plumbline.sources.package import MC

    def write(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(p["part_name"], p["content"], strict=True), key=lambda x: x[0].encode()):
                if name.endswith(".xml") and MC[1:-1].encode() in content:
                    content = ET.tostring(resolve(content, understood), "utf-8")
                if name.startswith("ppt/charts/"):
                    content = renumbered(content)
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.external_attr, info.compress_type = 0o600 << 16, zipfile.ZIP_DEFLATED
                z.writestr(info, content)
        return pd.DataFrame([{"package_id": key[0], "content": out.getvalue()}])

    return part.filter("problem is null").groupBy("package_id").applyInPandas(write, "package_id string, content binary")
