"""Small gradient-boosted trees with logistic loss on binned features (numpy only)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees grown level by level on quantile bins; deterministic.

    Trees are complete: arrays of split features and thresholds per inner node and values
    per leaf, so scoring is a few vectorised comparisons per tree.
    """

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.value = np.zeros((self.trees, inner), int), np.full((self.trees, inner),
            np.inf), np.zeros((self.trees, leaves))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                choice = [(0, np.inf)] * width
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    at = node * (len(c) + 1) + codes[:, f]
                    gs = np.bincount(at, g, width * (len(c) + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(at, h, width * (len(c) + 1)).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain = gain[:, :-1]
                    k = gain.argmax(1)
                    for n in range(width):
                        if gain[n, k[n]] > best[n]:
                            best[n], choice[n] = gain[n, k[n]], (f, c[k[n]])
                for n, (f, c) in enumerate(choice):
                    self.feature[t, first + n], self.cut[t, first + n] = f, c
                right = x[np.arange(len(y)), self.feature[t, first + node]] >= self.cut[t, first + node]
                node = 2 * node + right
            gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = self.rate * gl / (hl + self.ridge)
            margin += self.value[t][node]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] >= self.cut[t, at])
            margin += self.value[t][node]
        return 1 / (1 + np.exp(-margin))


def threshold(p: np.ndarray, y: np.ndarray, precision: float = 0.99, beta: float = 2.0, slack: float = 0.002, least: float = 0.2) -> float:
    """A held-out threshold of the wanted precision, by F-beta: recall counts ``beta`` times as much.

    The lowest whose F is within ``slack`` of the best, as the best one is a matter of few
    rows, but not below ``least``; in the middle of its gap.
    """
    order = np.argsort(-p, kind="stable")
    hit, taken = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    f = np.where(hit / taken >= precision, (1 + beta**2) * hit / (taken + beta**2 * y.sum()), 0.0)
    if not len(p) or not f.any():
        return 0.5
    last = int(np.flatnonzero(f >= f.max() - slack)[-1])
    below = p[order[last + 1]] if last + 1 < len(p) else 0.0
    return max(least, float((p[order[last]] + below) / 2))
