"""Cumulative-link models over sparse hashed features.

P(grade > k) = logistic(w.x - threshold_k) with thresholds in order and one weight
vector; with two grades it is logistic regression. Fitted with AdaGrad on target
distributions, with an L1 step that keeps words without evidence at zero; the weights of
the later half of the epochs are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: the features of row i are index[begin[i]:begin[i + 1]]."""

    begin: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        begin = np.concatenate(([0], np.cumsum([len(i) for i, _ in parts]))).astype(np.int64)
        index = np.concatenate([i for i, _ in parts] or [np.empty(0, np.int32)])
        return cls(begin, index, np.concatenate([v for _, v in parts] or [np.empty(0, np.float32)]))

    def only(self, keep: np.ndarray) -> Rows:
        """The rows with some of the features."""
        kept = keep[self.index]
        return Rows(np.concatenate(([0], np.cumsum(kept)))[self.begin], self.index[kept], self.value[kept])

    def compact(self) -> tuple[np.ndarray, Rows]:
        """The features that occur, and the rows with their places among them."""
        many = np.bincount(self.index, minlength=1)
        used = np.flatnonzero(many)
        number = np.full(len(many), -1, np.int32)
        number[used] = np.arange(len(used))
        return used, Rows(self.begin, number[self.index], self.value)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner within rows, index and value of all their features."""
        many = self.begin[rows + 1] - self.begin[rows]
        at = np.arange(many.sum()) + np.repeat(self.begin[rows] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        return np.repeat(np.arange(len(rows)), many), self.index[at], self.value[at]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, rows: Rows, target: np.ndarray, size: int, epochs: int = 12, batch: int = 256, rate: float = 0.5, l1: float = 1e-5, damping: float = 1e-6, seed: int = 7, weight: np.ndarray | None = None) -> CumulativeLink:
        """target: a distribution over the grades per row, weight: what each row counts. damping:
        squared gradients that every feature starts with; the larger, the smaller its first
        steps."""
        n, grades = target.shape
        used, rows, full_size = *rows.compact(), size
        size = max(1, len(used))
        weight = np.ones(n) if weight is None else weight
        w, seen = np.zeros(size), np.full(size, damping)
        tail = np.clip(1 - np.cumsum(np.average(target, axis=0, weights=weight))[:-1], 1e-3, 1 - 1e-3)
        cut = -np.log(tail / (1 - tail))
        cut_seen = np.full(grades - 1, 1e-6)
        order = np.random.default_rng(seed)
        tail_w, tail_cut = np.zeros(size), np.zeros(grades - 1)  # sums over the later epochs
        for epoch in range(epochs):
            for part in np.array_split(order.permutation(n), max(1, n // batch)):
                owner, index, value = rows.take(part)
                s = np.bincount(owner, weights=w[index] * value, minlength=len(part))
                t = target[part]
                tails = _sigmoid(s[:, None] - cut[None, :])
                full = np.hstack((np.ones((len(part), 1)), tails, np.zeros((len(part), 1))))
                p = np.maximum(full[:, :-1] - full[:, 1:], 1e-9)
                slope = np.hstack((np.zeros((len(part), 1)), tails * (1 - tails), np.zeros((len(part), 1))))
                ds = -(t / p * (slope[:, :-1] - slope[:, 1:])).sum(axis=1) * weight[part]
                ratio = t / p * weight[part][:, None]
                dcut = ((ratio[:, 1:] - ratio[:, :-1]) * slope[:, 1:-1]).sum(axis=0) / len(part)
                g = np.bincount(index, weights=ds[owner] * value, minlength=size) / len(part)
                at = np.flatnonzero(g)
                seen[at] += g[at] ** 2
                step = rate / np.sqrt(seen[at])
                new = w[at] - step * g[at]
                w[at] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
                cut_seen += dcut**2
                cut = np.maximum.accumulate(cut - rate * dcut / np.sqrt(cut_seen))
            if epoch >= epochs // 2:
                tail_w += w
                tail_cut += cut
        late = epochs - epochs // 2
        out = np.zeros(full_size)
        out[used] = tail_w[: len(used)] / late
        return cls(out, tail_cut / late)
