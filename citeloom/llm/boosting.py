"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of `depth` levels, every node of a level split on the feature and bin of the largest gain."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        x = np.asarray(x, float)
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        self.edges = [np.unique(np.append(e, (np.unique(x[:, k])[:8][:-1] + np.unique(x[:, k])[:8][1:]) / 2)) if len(np.unique(x[:, k])) > 1 else e for k, e in enumerate(self.edges)]
        b, width = self._binned(x), max(len(e) for e in self.edges) + 1
        p0 = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p0 / (1 - p0)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, 1e-9)
                feature, cut = np.zeros(n, np.int64), np.full(n, width, np.int64)
                gt, ht = np.bincount(node, g, n), np.bincount(node, h, n)
                for k in range(b.shape[1]):
                    key = node * width + b[:, k]
                    gl = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                    hl = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                    gain = gl**2 / (hl + self.ridge) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + self.ridge) - (gt**2 / (ht + self.ridge))[:, None]
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], k, at[better]
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)
            self.trees.append((splits, leaf))
            f += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class 1."""
        if not len(x):
            return np.zeros(0)
        b = self._binned(np.asarray(x, float))
        f = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for splits, leaf in self.trees:
            node = np.zeros(len(b), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))
