"""Static 3-wise binary-fuse filters with 8-bit fingerprints (Graf and Lemire, 2022), in numpy.

A set of 64-bit keys is fixed when the filter is made. Three places in neighbouring segments are
given to a key, and the fingerprints at its places XOR to the key's own. Peeling runs in rounds:
all places with one key left are taken at once.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + _U(seed)
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


class FuseFilter:
    def __init__(self, seed: int, length: int, segments: int, prints: np.ndarray):
        self.seed, self.length, self.segments, self.prints = seed, length, segments, prints

    @staticmethod
    def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
        at = (((h >> _U(32)) * _U(length * segments)) >> _U(32)).astype(np.int64)
        mask = length - 1
        return np.stack([at, (at + length) ^ ((h >> _U(18)).astype(np.int64) & mask), (at + 2 * length) ^ (h.astype(np.int64) & mask)])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(32))) & _U(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """keys: distinct 64-bit values."""
        n = len(keys)
        length = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        roomy = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, -(-int(roomy) // length) - 2)
        for attempt in range(1, 200):
            h = mixed(keys, attempt * 0x9E3779B97F4A7C15 % 2**64)
            places = cls._places(h, length, segments)
            if (order := cls._peel(places, (segments + 2) * length)) is not None:
                break
        else:
            raise ValueError("keys are not distinct")
        prints, own = np.zeros((segments + 2) * length, np.uint8), cls._print(h)
        for taken, slot in reversed(order):
            p = places[:, taken]
            value = own[taken] ^ prints[p[0]] ^ prints[p[1]] ^ prints[p[2]]  # the slot itself is still 0
            prints[slot] = value
        return cls(attempt * 0x9E3779B97F4A7C15 % 2**64, length, segments, prints)

    @staticmethod
    def _peel(places: np.ndarray, size: int):
        n = places.shape[1]
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.bincount(places.ravel(), np.tile(np.arange(n, dtype=np.float64), 3), size).astype(np.int64)
        order, left, single = [], n, np.flatnonzero(count == 1)
        while len(single):
            taken, first = np.unique(owner[single], return_index=True)
            order.append((taken, single[first]))
            left -= len(taken)
            touched = places[:, taken].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(owner, touched, np.tile(taken, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        return None if left else order

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for 1 in 256 others."""
        h = mixed(keys, self.seed)
        p = self._places(h, self.length, self.segments)
        return (self.prints[p[0]] ^ self.prints[p[1]] ^ self.prints[p[2]]) == self._print(h)
