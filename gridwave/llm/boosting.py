"""Gradient-boosted trees for small feature tables, on NumPy alone."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits, Newton leaf values; deterministic."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10, l2: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.least, self.l2, self.bins = trees, depth, rate, least, l2, bins
        self.forest: list[list[tuple]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.bias = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.bias)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            tree, step = self._tree(binned, prob - y, prob * (1 - prob))
            self.forest.append(tree)
            raw += step
        nodes = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.value = np.full((self.trees, nodes), -1), np.zeros((self.trees, nodes), int), np.zeros((self.trees, nodes))
        for i, tree in enumerate(self.forest):
            for k, (f, t, v) in tree.items():
                self.feature[i, k], self.cut[i, k], self.value[i, k] = f, t, v
        return self

    def _tree(self, b, g, h):
        node, out, tree = np.zeros(len(g), int), np.zeros(len(g)), {}
        stack = [(0, np.arange(len(g)), 0)]
        while stack:
            k, rows, depth = stack.pop()
            split = self._split(b[rows], g[rows], h[rows]) if depth < self.depth else None
            if split is None:
                value = -self.rate * g[rows].sum() / (h[rows].sum() + self.l2)
                tree[k] = (-1, 0, value)
                out[rows] = value
                continue
            f, t = split
            tree[k] = (f, t, 0.0)
            left = b[rows, f] <= t
            stack += [(2 * k + 1, rows[left], depth + 1), (2 * k + 2, rows[~left], depth + 1)]
        return tree, out

    def _split(self, b, g, h):
        best, where = 1e-3, None
        whole = g.sum() ** 2 / (h.sum() + self.l2)
        for f in range(b.shape[1]):
            n = len(self.edges[f]) + 1
            cg, ch, cn = (np.cumsum(np.bincount(b[:, f], weights=w, minlength=n))[:-1] for w in (g, h, np.ones(len(g))))
            gain = cg**2 / (ch + self.l2) + (g.sum() - cg) ** 2 / (h.sum() - ch + self.l2) - whole
            gain[(cn < self.least) | (len(g) - cn < self.least)] = -1
            if len(gain) and gain.max() > best:
                best, where = gain.max(), (f, int(gain.argmax()))
        return where

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the class 1."""
        x = np.asarray(x, float)
        if not len(x):
            return np.empty(0)
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        raw, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cut[at]), at)
            raw += value[at]
        return 1 / (1 + np.exp(-raw))
