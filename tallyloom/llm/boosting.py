"""Gradient-boosted regression trees for the logistic loss, on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    base: float = 0.0
    #: A tree is four arrays over heap-numbered nodes: feature, threshold, value, leaf flag.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                down = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
                at = np.where(leaf[at], at, down)
            out += value[at]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 5.0) -> Boosted:
    """Newton boosting: every split has the largest gain in squared gradient over curvature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p0 / (1 - p0))), [], depth)
    margin, size = np.full(len(y), model.base), 2 ** (depth + 1) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, value, leaf = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.ones(size, bool)
        todo = [(0, np.arange(len(y)))]
        while todo:
            node, rows = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -rate * gs / (hs + penalty)
            margin[rows] += value[node]
            if 2 * node + 2 >= size:
                continue
            best = (1e-6, -1, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                gain[(hl < least / 4) | (hs - hl < least / 4)] = 0
                if gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                continue
            margin[rows] -= value[node]
            feature[node], cut[node], leaf[node] = best[1], edges[best[1]][best[2]], False
            right = code[rows, best[1]] > best[2]
            todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
        model.trees.append((feature, cut, value, leaf))
    return model
