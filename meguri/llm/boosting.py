"""Gradient-boosted depth-limited trees for a yes/no label, with calibration.

Fits a bounded sample in memory; scoring is vectorised numpy, so a fitted model
can be sent to tasks. The size of a model is rounds x 2^depth nodes.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting over binned features; every tree is a full binary tree."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.bias = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """x: (rows, features) float; y: 0 or 1. No rows: always even odds."""
        if len(y) == 0:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, edges, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, binned, edges, gradient, hessian):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(gradient), dtype=np.int64)
        for level in range(self.depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                here = node == k
                feature[k], cut[k] = self._best(binned[here], edges, gradient[here], hessian[here])
            f, c = feature[node], cut[node]
            raw = np.array([e.size for e in edges])
            at = np.array([np.searchsorted(edges[j], v) if np.isfinite(v) else raw[j] + 1 for j, v in zip(feature, cut)])
            node = 2 * node + 1 + (binned[np.arange(len(node)), f] > at[node])
            del c
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, 2**self.depth), np.bincount(leaf, hessian, 2**self.depth)
        return feature, cut, self.rate * g / (h + self.l2)

    def _best(self, binned, edges, gradient, hessian):
        best = (1e-9, 0, np.inf)
        if len(gradient) < 4:
            return best[1:]
        total_g, total_h = gradient.sum(), hessian.sum()
        score = lambda g, h: g * g / (h + self.l2)
        for j, e in enumerate(edges):
            if e.size == 0:
                continue
            g = np.cumsum(np.bincount(binned[:, j], gradient, e.size + 1))[:-1]
            h = np.cumsum(np.bincount(binned[:, j], hessian, e.size + 1))[:-1]
            gain = score(g, h) + score(total_g - g, total_h - h) - score(total_g, total_h)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, e[k])
        return best[1:]

    def _walk(self, tree, x):
        feature, cut, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return value[node - (2**self.depth - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += self._walk(tree, x)
        return out


class Calibrated:
    """Trees, Platt-scaled on rows the trees have not seen, and the least
    calibrated score per kind at which held-out precision reaches ``precision``."""

    def __init__(self, trees: Trees, precision: float = 0.98, least: int = 20):
        self.trees, self.precision, self.least = trees, precision, least
        self.scale, self.shift, self.cut = 1.0, 0.0, {}

    def fit(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, held: np.ndarray) -> Calibrated:
        self.trees.fit(x[~held], y[~held])
        m, t, k = self.trees.margin(x[held]), y[held].astype(float), kind[held]
        if len(t) and 0 < t.sum() < len(t):
            for _ in range(50):  # Newton steps on two parameters
                p = 1 / (1 + np.exp(-(self.scale * m + self.shift)))
                w, e = np.maximum(p * (1 - p), 1e-9), t - p
                h = np.array([[np.sum(w * m * m) + 1e-3, np.sum(w * m)], [np.sum(w * m), np.sum(w) + 1e-3]])
                d = np.linalg.solve(h, [np.sum(e * m) - 1e-3 * (self.scale - 1), np.sum(e) - 1e-3 * self.shift])
                self.scale, self.shift = self.scale + float(np.clip(d[0], -1, 1)), self.shift + float(np.clip(d[1], -1, 1))
        p = self.score(x[held])
        for name in np.unique(kind):
            s, z = p[k == name], t[k == name]
            self.cut[str(name)] = np.inf  # too little to judge by: accept nothing
            if z.sum() >= self.least:
                order = np.argsort(-s, kind="stable")
                share = np.cumsum(z[order]) / np.arange(1, len(s) + 1)
                ends = np.append(s[order][1:] < s[order][:-1], True)
                good = np.flatnonzero(ends & (share >= self.precision))
                if len(good):
                    self.cut[str(name)] = max(0.5, float(s[order][good[-1]]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.trees.margin(x) + self.shift)))
