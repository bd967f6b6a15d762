"""Hashed byte n-grams of whole texts, counted in numpy over a slice of an Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plumbline.llm.common import text_bytes


def gram_hashes(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], bits: int, table: bytes, inside_words: bool):
    """Yields (row, bucket) arrays, one pair for each n-gram length.

    table maps bytes first (0x20 for what separates words). N-grams never reach over a row's
    end. With inside_words those with a blank at an inner place are left out, so that a blank
    at either end marks where a word begins or ends.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return
    b = np.frombuffer(table, np.uint8)[data[lo:hi]]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = np.repeat((offsets[1:] - lo).astype(np.int32), sizes) - np.arange(hi - lo, dtype=np.int32)
    blank = b == 32
    key = b.astype(np.uint32)
    inner = np.zeros(len(b), bool)  # a blank at the second to last but one place
    for n in range(2, max(lengths) + 1):
        if len(b) < n:
            return
        key = key[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if inside_words and n > 2:
            inner = inner[: len(key)] | blank[n - 2 : n - 2 + len(key)]
        if n in lengths:
            keep = left[: len(key)] >= n
            if inside_words:
                keep &= ~inner[: len(key)] & ~(blank[: len(key)] & blank[n - 1 :])
            k = key[keep] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            k = (k ^ (k >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield row[: len(keep)][keep], ((k ^ (k >> np.uint32(13))) >> np.uint32(32 - bits)).astype(np.int64)


def counts(column: pa.Array, lengths: tuple[int, ...], bits: int, table: bytes, inside_words: bool) -> np.ndarray:
    """Rows x 2**bits counts of n-grams."""
    data, offsets = text_bytes(column)
    out = np.zeros(len(column) << bits, np.int64)
    with np.errstate(over="ignore"):
        for row, bucket in gram_hashes(data, offsets, lengths, bits, table, inside_words):
            out += np.bincount((row.astype(np.int64) << bits) + bucket, minlength=len(out))
    return out.reshape(len(column), 1 << bits)
