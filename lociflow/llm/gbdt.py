"""Gradient-boosted trees for two classes, in numpy: histograms of at most 32 bins, full trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """feature, cut: trees x inner nodes; value: trees x leaves. A row goes right where x[feature] > cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Boosting on the logistic loss. x: rows x features, y: 0 or 1."""
    n, m = x.shape
    w = np.ones(n) if weight is None else weight
    cuts, binned = [], np.empty((m, n), np.int64)
    for j in range(m):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(x[:, j])) > BINS else np.unique(x[:, j])[:-1]
        cuts.append(q)
        binned[j] = np.searchsorted(q, x[:, j], "left")
    p0 = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    f_all, c_all, v_all, margin = [], [], [], np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        at, feat, cut = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            best = np.full(width, 1e-9)
            local = at - first
            bf, bb = np.zeros(width, np.int64), np.full(width, BINS)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = local * (BINS + 1) + binned[j]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                k = gain[:, : len(cuts[j])].argmax(1)
                top = gain[np.arange(width), k]
                win = top > best
                best[win], bf[win], bb[win] = top[win], j, k[win]
            for i in range(width):
                feat[first + i] = bf[i]
                cut[first + i] = cuts[bf[i]][bb[i]] if bb[i] < BINS else np.inf
            at = 2 * at + 1 + (x[np.arange(n), feat[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        f_all.append(feat)
        c_all.append(cut)
        v_all.append(value)
    return Trees(np.array(f_all), np.array(c_all), np.array(v_all), base)
