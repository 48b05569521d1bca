"""Gradient-boosted regression trees for a binary label, on histograms.

Small enough to train on the driver in seconds, and evaluated on whole batches.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Log-odds of a label from numeric features; trees of fixed depth."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, f = x.shape
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], qs)) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(prior / (1 - prior)))
        score = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)  # node within its level
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                pick = np.full(width, -1)
                where = np.zeros(width, np.int64)
                for j in range(f):
                    k = len(self.edges[j]) + 1
                    if k == 1:
                        continue
                    cell = at * k + binned[:, j]
                    g = np.bincount(cell, grad, width * k).reshape(width, k).cumsum(axis=1)
                    h = np.bincount(cell, hess, width * k).reshape(width, k).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.least) + (gt - g) ** 2 / (ht - h + self.least) - gt**2 / (ht + self.least)
                    gain = gain[:, :-1]
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(width), top]
                    better = value > best + 1e-9
                    best[better], pick[better], where[better] = value[better], j, top[better]
                right = np.zeros(n, np.int64)
                for node in range(width):
                    if pick[node] >= 0:
                        j = pick[node]
                        self.feature[t, first + node] = j
                        self.cut[t, first + node] = self.edges[j][where[node]]
                        mine = at == node
                        right[mine] = binned[mine, j] > where[node]
                at = 2 * at + right
            g = np.bincount(at, grad, inner + 1)
            h = np.bincount(at, hess, inner + 1)
            self.leaf[t] = self.rate * g / (h + self.least)
            score += self.leaf[t][at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            out += leaf[at - len(cut)]
        return out
