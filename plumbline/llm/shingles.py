"""Distinct hashed word shingles of whole texts, in numpy over slices of Arrow batches.

A word's hash reads its bytes eight at a time; every step multiplies and shifts, so that no family
of words collides by its form. Words of over LONG bytes are hashed by BLAKE2b. Different shingles
share a 64-bit hash by chance only, two given ones with probability 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from plumbline.llm.common import LOWER_BYTES, text_bytes
from plumbline.llm.fuse import mixed

_LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP, _LANE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The low bytes of a lane that belong to a word, by how many they are.
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longest word in bytes that is hashed in numpy.
LONG = 128


def byte_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[starts : starts + sizes]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data), "<u8", padded.data, strides=(1,))
    h = mixed(sizes.astype(np.uint64), 0x1234567)
    short = sizes <= LONG
    at = np.flatnonzero(short)
    done = 0
    with np.errstate(over="ignore"):
        while len(at):
            x = lanes[starts[at] + done] & _PART[np.minimum(8, sizes[at] - done)]
            x = (x ^ (x >> np.uint64(32))) * _LANE
            x = (h[at] ^ x ^ (x >> np.uint64(29))) * _STEP
            h[at] = x ^ (x >> np.uint64(32))
            done += 8
            at = at[sizes[at] > done]
    for k in np.flatnonzero(~short):
        word = data[starts[k] : starts[k] + sizes[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return mixed(h, 0)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of anything but ASCII white space, A-Z lowered), and their rows."""
    data, offsets = text_bytes(column)
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lo == hi:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b, ends = _LOWER[data[lo:hi]], offsets[1:] - lo
    word = ~_SPACE[b]
    cuts = (offsets[:-1] - lo)[offsets[:-1] < offsets[1:]]  # words end where rows do
    begins, last = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[cuts] = word[cuts]
    last[:-1] &= ~word[1:]
    last[cuts[1:] - 1] = word[cuts[1:] - 1]
    starts = np.flatnonzero(begins)
    return byte_hashes(b, starts, np.flatnonzero(last) + 1 - starts), np.searchsorted(ends, starts, "right")


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a shorter text is one shingle, none without words."""
    words, rows = word_hashes(column)
    bounds = np.searchsorted(rows, np.arange(len(column) + 1))
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        m = max(0, len(words) - width + 1)
        full = np.full(m, np.uint64(width))
        for j in range(width):
            full = (full ^ words[j : j + m]) * _STEP
            full ^= full >> np.uint64(29)
    full = mixed(full, width) if m else full
    none, out = np.zeros(0, np.uint64), []
    for k in range(len(column)):
        if n[k] >= width:
            out.append(np.unique(full[bounds[k] : bounds[k + 1] - width + 1]))
        elif n[k]:
            h = np.full(1, np.uint64(n[k]))
            with np.errstate(over="ignore"):
                for w in words[bounds[k] : bounds[k + 1]]:
                    h = (h ^ w) * _STEP
                    h ^= h >> np.uint64(29)
            out.append(mixed(h, width))
        else:
            out.append(none)
    return out
