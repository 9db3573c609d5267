"""Gradient-boosted regression trees on binned features, for two labels."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out = np.full(len(x), self.bias)
        if not len(x):
            return out
        b = self.bins(x)
        rows = np.arange(len(b))
        for feature, cut, value in self.trees:
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Boosted:
    """Newton boosting of the log loss; complete trees, a node without gain sends all rows left."""
    model = Boosted(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T], depth=depth)
    b, score, n = model.bins(x), np.full(len(x), model.bias), x.shape[1]
    offset = np.arange(n) * (bins + 1)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, value = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins + 1), np.zeros((2 << depth) - 1)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            slot = ((at - base)[:, None] * (n * (bins + 1)) + offset + b).ravel()
            size = width * n * (bins + 1)
            gs, hs = (np.bincount(slot, np.repeat(v, n), size).reshape(width, n, bins + 1).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            best = gain.reshape(width, -1).argmax(1)
            useful = gain.reshape(width, -1).max(1) > 1e-6
            feature[base : base + width] = np.where(useful, best // (bins + 1), 0)
            cut[base : base + width] = np.where(useful, best % (bins + 1), bins + 1)
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
        leaf = np.bincount(at, g, len(value)) / (np.bincount(at, h, len(value)) + ridge)
        value[(1 << depth) - 1 :] = rate * leaf[(1 << depth) - 1 :]
        model.trees.append((feature, cut, value))
        score += value[at]
    return model
