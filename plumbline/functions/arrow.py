"""Functions that Spark lacks, in Arrow batches: canonical JSON, NFC, HMAC, paths, SSIM."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jcs(value) -> str:
    """RFC 8785: keys by UTF-16 units, shortest numbers as ECMAScript writes them."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return number(float(value)) if abs(value) > 2**53 else str(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, list):
        return f"[{','.join(map(jcs, value))}]"
    return "{" + ",".join(f"{jcs(k)}:{jcs(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"


def number(x: float) -> str:
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *repr_parts(abs(x))
    n = len(digits)
    if n <= exponent <= 21:
        return sign + digits + "0" * (exponent - n)
    if 0 < exponent <= 21:
        return f"{sign}{digits[:exponent]}.{digits[exponent:]}"
    if -6 < exponent <= 0:
        return f"{sign}0.{'0' * -exponent}{digits}"
    e = exponent - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def repr_parts(x: float) -> tuple[str, int]:
    """Shortest digits and the place of the point: x = 0.digits * 10 ** place."""
    mantissa, _, exp = f"{x!r}".partition("e")
    whole, _, frac = mantissa.partition(".")
    digits = (whole + frac).lstrip("0")
    place = len(whole) + int(exp or 0) if whole.strip("0") else int(exp or 0) - (len(frac) - len(frac.lstrip("0")))
    return digits.rstrip("0"), place


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """RFC 8785 form of JSON texts; null stays null."""
    return text.map(lambda t: None if t is None else jcs(json.loads(t)))


@F.pandas_udf(T.BooleanType())
def is_nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t))


def hmac_sha256(secret: bytes):
    """A function of text columns: hex HMAC."""

    @F.pandas_udf(T.StringType())
    def signed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(secret, t.encode(), hashlib.sha256).hexdigest())

    return signed


@F.pandas_udf(T.StringType())
def resolve_target(base: pd.Series, target: pd.Series) -> pd.Series:
    """A relationship's target as a part name: percent-decoded, relative to the source's folder.

    Null for external ones (with a scheme) and for those that leave the package."""

    from plumbline.sources.markup import target_of

    return pd.Series([None if b is None else target_of(b, t) for b, t in zip(base, target, strict=True)])


def ssim(a: np.ndarray, b: np.ndarray, span: float = 255.0, window: int = 7) -> float:
    """Mean structural similarity of two rasters (h x w, or h x w x channels); 0 if shapes differ.

    A uniform window, sample covariance, K1 = 0.01 and K2 = 0.03 (fixed values)."""
    if a.shape != b.shape:
        return 0.0
    if a.ndim == 3:
        return float(np.mean([ssim(a[..., c], b[..., c], span, window) for c in range(a.shape[2])]))
    if min(a.shape) < window:
        return 0.0

    def box(x):
        return np.lib.stride_tricks.sliding_window_view(x, (window, window)).mean(axis=(2, 3))

    a, b = a.astype(float), b.astype(float)
    n = window * window
    ma, mb = box(a), box(b)
    va, vb, ab = (n / (n - 1) * (box(x * y) - mx * my) for x, y, mx, my in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float(((2 * ma * mb + c1) * (2 * ab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def amplified(a: np.ndarray, b: np.ndarray, times: int = 10) -> np.ndarray:
    """clip(|a - b| * times, 0, 255) of byte rasters, without wrapping around."""
    return np.clip(np.abs(a.astype(np.int16) - b.astype(np.int16)) * times, 0, 255).astype(np.uint8)


def ssim_of(side: int, span: float):
    """A function of two array columns that are side x side rasters."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None or len(x) != len(y) or len(x) != side * side else ssim(np.asarray(x).reshape(side, side), np.asarray(y).reshape(side, side), span) for x, y in zip(a, b, strict=True)])

    return score
