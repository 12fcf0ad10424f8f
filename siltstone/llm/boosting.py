"""A small gradient-boosted tree classifier (logistic loss, histogram splits) in numpy, with Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Tree = list[tuple[int, float, float]]


@dataclass
class BoostedTrees:
    """Complete binary trees of a fixed depth, as rows (feature, threshold) of inner nodes and leaf values."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), int))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score, inner = np.full(n, self.base), 2**self.depth - 1
        features, cuts, leaves = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            at = np.zeros(n, int)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                j, b = self._split(binned[rows], g[rows], h[rows], edges) if len(rows) > 3 else (0, -1)
                if b >= 0:
                    feature[node], cut[node] = j, edges[j][b]
                    right = binned[rows, j] > b
                else:
                    right = np.zeros(len(rows), bool)
                at[rows] = 2 * node + 1 + right
            leaf = at - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2) * self.rate
            score += value[leaf]
            features.append(feature), cuts.append(cut), leaves.append(value)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int]:
        best, where = 1e-6, (0, -1)
        total_g, total_h = g.sum(), h.sum()
        whole = total_g**2 / (total_h + self.l2)
        for j, e in enumerate(edges):
            if len(e):
                left_g = np.cumsum(np.bincount(binned[:, j], g, len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[:, j], h, len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - whole
                b = int(np.argmax(gain))
                if gain[b] > best:
                    best, where = gain[b], (j, b)
        return where

    def margin(self, x: np.ndarray) -> np.ndarray:
        score, inner = np.full(len(x), self.base), 2**self.depth - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += leaf[at - inner]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fits probability = sigmoid(a * margin + b) on rows not used for the trees."""
        m, (a, b) = self.margin(x), (1.0, 0.0)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * m).sum() + 1e-3 * (a - 1), (p - target).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-8:
                break
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))
