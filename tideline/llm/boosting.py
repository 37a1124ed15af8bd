"""Histogram gradient boosting for binary labels, and its trees as flat arrays.

Training bins each feature by quantiles of the sample and grows trees level by level from histograms of
gradients and Hessians (one bincount per feature and level). A model is a handful of arrays (feature,
threshold, children, value of each node), so scoring walks all rows of a batch at once, level by level.
Features that are NaN go left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # int32[nodes]; -1 at leaves
    threshold: np.ndarray  # float64[nodes]; greater values go right
    left: np.ndarray  # int32[nodes]; the right child is the next one
    value: np.ndarray  # float64[nodes]
    roots: np.ndarray  # int32[trees]
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: int = 10) -> Trees:
    n, width = x.shape
    x = np.nan_to_num(x, nan=-np.inf, neginf=-1e300, posinf=1e300)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, width), int)
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = node()
        roots.append(root)
        at, level = np.full(n, root), [root]
        for d in range(depth + 1):
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            s = slot[at]
            live = s >= 0
            k = len(level)
            gs, hs = np.bincount(s[live], g[live], k), np.bincount(s[live], h[live], k)
            for i, v in enumerate(level):
                value[v] = -rate * gs[i] / (hs[i] + ridge)
            if d == depth:
                break
            best = np.full(k, 1e-6)
            pick = [(-1, 0)] * k
            for j in range(width):
                nb = len(edges[j]) + 1
                if nb < 2:
                    continue
                cell = s[live] * nb + binned[live, j]
                gl, hl, nl = (np.bincount(cell, w, k * nb).reshape(k, nb).cumsum(1)[:, :-1] for w in (g[live], h[live], np.ones(live.sum())))
                nr = np.bincount(s[live], minlength=k)[:, None] - nl
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                gain[(nl < least) | (nr < least)] = -1
                b = gain.argmax(1)
                top = gain[np.arange(k), b]
                for i in np.flatnonzero(top > best):
                    best[i], pick[i] = top[i], (j, int(b[i]))
            grown = []
            for i, v in enumerate(level):
                j, b = pick[i]
                if j < 0:
                    continue
                feature[v], threshold[v] = j, float(edges[j][b])
                left[v] = node()
                node()
                mine = at == v
                at[mine] = left[v] + (binned[mine, j] > b)
                grown += [left[v], left[v] + 1]
            if not grown:
                break
            level = grown
        margin += np.asarray(value)[at]
    return Trees(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(value), np.array(roots, np.int32), depth, base)
