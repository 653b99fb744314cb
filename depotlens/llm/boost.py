"""Gradient boosted trees on a bounded sample: logistic loss, binned features, trees grown level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    start: float
    cuts: list[np.ndarray]  # by feature
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by node in heap order: feature (-1: none), bin, value
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        total = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            total += value[leaf_of(bins, feature, cut, self.depth)]
        return 1 / (1 + np.exp(-total))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(cuts) else x.astype(int)


def leaf_of(bins, feature, cut, depth):
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > cut[node]))
    return node


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    own = binned(x, cuts)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        slope, curve = y - p, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if not len(at):
                    continue
                g, h = slope[at].sum(), curve[at].sum()
                value[k] = rate * g / (h + ridge)
                best = (1e-6, -1, 0)
                for j in range(x.shape[1]) if level < depth else ():
                    n = len(cuts[j]) + 1
                    left_g = np.cumsum(np.bincount(own[at, j], slope[at], n))[:-1]
                    left_h = np.cumsum(np.bincount(own[at, j], curve[at], n))[:-1]
                    if len(left_g):
                        gain = left_g ** 2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g ** 2 / (h + ridge)
                        b = int(gain.argmax())
                        best = max(best, (float(gain[b]), j, b))
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], best[2]
                    node[at] = 2 * k + 1 + (own[at, best[1]] > best[2])
        trees.append((feature, cut, value))
        total += value[node]
    return Forest(start, cuts, trees, depth)
