"""Random forests of two classes in numpy: histogram splits, bootstrap rows, random features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEVELS = 32


@dataclass(frozen=True)
class Forest:
    edges: np.ndarray  # features x LEVELS - 1
    feature: np.ndarray  # trees x nodes, -1 at leaves
    level: np.ndarray  # go left where the binned feature is at most this
    value: np.ndarray  # share of class 1 in the node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 over the trees."""
        b, rows, out = binned(x, self.edges), np.arange(len(x)), np.zeros(len(x))
        for feature, level, value in zip(self.feature, self.level, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = b[rows, np.maximum(f, 0)] > level[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out / len(self.feature)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 0) -> Forest:
    """x: rows x features, y: 0 or 1."""
    rng = np.random.default_rng(seed)
    edges = np.quantile(x, np.linspace(0, 1, LEVELS + 1)[1:-1], axis=0).T
    b, wide = binned(x, edges), x.shape[1]
    some = max(1, int(np.sqrt(wide)) + 1)
    size = 2 ** (depth + 1) - 1
    feature, level, value = np.full((trees, size), -1), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        drawn = rng.integers(0, len(x), len(x))
        todo = [(0, drawn)]
        while todo:
            node, rows = todo.pop()
            n, ones = len(rows), int(y[rows].sum())
            value[t, node] = ones / max(1, n)
            if n < 2 * least or ones in (0, n) or node >= 2**depth - 1:
                continue
            best, cut = ones * (n - ones) / n - 1e-9, None
            for f in rng.permutation(wide)[:some]:
                k = np.cumsum(np.bincount(b[rows, f], minlength=LEVELS))[:-1]
                p = np.cumsum(np.bincount(b[rows, f], y[rows], LEVELS))[:-1]
                ok = (k >= least) & (n - k >= least)
                left, right = p * (k - p) / np.maximum(k, 1), (ones - p) * (n - k - ones + p) / np.maximum(n - k, 1)
                impure = np.where(ok, left + right, np.inf)
                if impure.min() < best:
                    best, cut = impure.min(), (f, int(impure.argmin()))
            if cut:
                feature[t, node], level[t, node] = cut
                right = b[rows, cut[0]] > cut[1]
                todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
    return Forest(edges, feature, level, value)
