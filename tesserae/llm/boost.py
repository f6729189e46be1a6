"""Gradient-boosted trees for the logistic loss, small enough to be fitted on the driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth over cut values; each node is chosen by the gain of its split."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, cuts: int = 24) -> None:
        self.rounds, self.depth, self.rate, self.most = rounds, depth, rate, cuts
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        at = np.full(len(y), self.base)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.most + 2)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        width = self.most + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-at))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            inner = (1 << self.depth) - 1
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = (1e-6, 0, None)
                if len(rows) > 1:
                    for f in range(x.shape[1]):
                        gs = np.bincount(binned[rows, f], g[rows], width)
                        hs = np.bincount(binned[rows, f], h[rows], width)
                        lg, lh = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                        gain = lg**2 / (lh + 1) + (gs.sum() - lg) ** 2 / (hs.sum() - lh + 1) - gs.sum() ** 2 / (hs.sum() + 1)
                        b = int(gain[: len(edges[f])].argmax()) if len(edges[f]) else 0
                        if len(edges[f]) and gain[b] > best[0]:
                            best = (gain[b], f, edges[f][b])
                if best[2] is not None:
                    feature[k], cut[k] = best[1], best[2]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            leaf = node - inner
            n = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            self.trees.append((feature, cut, value))
            at += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        at = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            at += value[node - len(feature)]
        return 1 / (1 + np.exp(-at))
