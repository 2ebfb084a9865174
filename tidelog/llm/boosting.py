"""Gradient-boosted decision trees on the logistic loss, and their form as SQL."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Small boosted trees; ``sql`` writes them as one expression."""

    def __init__(self, n_trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8):
        self.n_trees, self.depth, self.rate, self.least = n_trees, depth, rate, least
        self.trees: list = []
        self.start = 0.0
        self.slope, self.shift = 1.0, 0.0

    def _grow(self, x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
        value = float(self.rate * gradient.sum() / (weight.sum() + 1.0))
        if depth == 0 or len(x) < 2 * self.least:
            return value
        total_g, total_w = gradient.sum(), weight.sum()
        best = (1e-6, None, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            col, g, w = x[order, j], np.cumsum(gradient[order])[:-1], np.cumsum(weight[order])[:-1]
            gain = g**2 / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1)
            gain[(col[1:] == col[:-1])] = 0
            gain[: self.least - 1] = 0
            gain[len(gain) - self.least + 1 :] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, float((col[k] + col[k + 1]) / 2))
        _, j, at = best
        if j is None:
            return value
        left = x[:, j] <= at
        return (j, at, self._grow(x[left], gradient[left], weight[left], depth - 1), self._grow(x[~left], gradient[~left], weight[~left], depth - 1))

    @staticmethod
    def _walk(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, at, low, high = tree
        return np.where(x[:, j] <= at, BoostedTrees._walk(low, x), BoostedTrees._walk(high, x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            raw += self._walk(tree, x)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._walk(t, x) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that were not trained on."""
        raw = self.raw(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(100):
            p = 1 / (1 + np.exp(-(self.slope * raw + self.shift)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - target) * raw).sum(), (p - target).sum()])
            h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            self.slope, self.shift = self.slope - float(step[0]), self.shift - float(step[1])
            if np.abs(step).max() < 1e-8:
                break
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def _sql(self, tree, names: list[str]) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        j, at, low, high = tree
        return f"CASE WHEN {names[j]} <= {at!r}D THEN {self._sql(low, names)} ELSE {self._sql(high, names)} END"

    def sql(self, names: list[str]) -> str:
        trees = " + ".join(self._sql(t, names) for t in self.trees)
        return f"1D / (1D + exp(-({self.slope!r}D * ({self.start!r}D + {trees}) + {self.shift!r}D)))"
