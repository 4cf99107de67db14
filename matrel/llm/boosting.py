"""Gradient-boosted trees over a bounded dense matrix, and isotonic calibration; numpy only, run where the sample is."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits, leaf values by one Newton step. Deterministic; ties take the first feature."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, min_leaf: int = 5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.min_leaf, self.ridge = rounds, depth, rate, bins, min_leaf, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        rate = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1) if n else np.zeros((0, m), int)
        score = np.full(n, self.base)
        self.trees = []
        for _ in range(self.rounds if n else 0):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.rate * tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree in heap order: feature (-1: pass left), cut value, leaf values by heap position."""
        size = 2 ** (self.depth + 1)
        feature, cut, value = np.full(size, -1), np.full(size, np.inf), np.zeros(size)
        at = np.ones(len(g), int)
        wide = self.bins + 1
        for level in range(self.depth):
            for node in range(2**level, 2 ** (level + 1)):
                rows = np.flatnonzero(at == node)
                best = (1e-9, -1, 0)
                if len(rows) >= 2 * self.min_leaf:
                    gr, hr = g[rows], h[rows]
                    total = gr.sum() ** 2 / (hr.sum() + self.ridge)
                    for j, cuts in enumerate(self.cuts):
                        if not len(cuts):
                            continue
                        b = binned[rows, j]
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, wide))[: len(cuts)] for w in (gr, hr, None))
                        gain = gl**2 / (hl + self.ridge) + (gr.sum() - gl) ** 2 / (hr.sum() - hl + self.ridge) - total
                        gain[(nl < self.min_leaf) | (len(rows) - nl < self.min_leaf)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                    right = binned[rows, best[1]] > best[2]
                    at[rows] = 2 * node + right
                else:
                    at[rows] = 2 * node
        for node in range(2**self.depth, size):
            rows = at == node
            value[node] = g[rows].sum() / (h[rows].sum() + self.ridge)
        return (feature, cut, value), at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.ones(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] >= cut[at]))
            out += self.rate * value[at]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of probability on score; steps, with linear interpolation between block centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        at, back = np.unique(score, return_inverse=True)  # equal scores are one point, so their order does not matter
        blocks: list[list[float]] = []  # sum of y, count, sum of score
        for s, v, n in zip(at, np.bincount(back, y, len(at)), np.bincount(back, minlength=len(at))):
            blocks.append([float(v), float(n), float(s) * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])
        self.y = np.maximum.accumulate(self.y) if len(blocks) else self.y
        return self

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else 1 / (1 + np.exp(-score))
