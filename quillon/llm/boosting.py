"""Small learners on dense matrices: histogram gradient-boosted trees with logistic loss, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth; node i has children 2i + 1 and 2i + 2."""

    edges: list[np.ndarray]  # bin edges of each feature
    base: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    bin: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int32) if len(x) else np.zeros(x.shape, np.int32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.bin, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Fit by second-order boosting on quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(share / (1 - share))), depth)
    b = model.binned(x)
    margin, inner = np.full(len(y), model.base), 2**depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int32), np.full(inner, bins, np.int32)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            slot = (node - first) * (bins + 1)
            for j in range(x.shape[1]):
                at = slot + b[:, j]
                gs = np.bincount(at, g, count * (bins + 1)).reshape(count, -1).cumsum(1)
                hs = np.bincount(at, h, count * (bins + 1)).reshape(count, -1).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                at_best = gain.argmax(1)
                value = gain[np.arange(count), at_best]
                better = value > best
                best[better] = value[better]
                feature[first : first + count][better] = j
                cut[first : first + count][better] = at_best[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        end = node - inner
        leaf = -rate * np.bincount(end, g, 2**depth) / (np.bincount(end, h, 2**depth) + ridge)
        margin += leaf[end]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    model.feature, model.bin, model.leaf = np.array(features), np.array(cuts), np.array(leaves)
    return model


@dataclass
class Isotonic:
    """A non-decreasing map from margins to probabilities, linear between the pooled blocks."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each block's mean is drawn towards the overall mean by one row, so that 0 and 1 are never given."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, t in zip(x[order], y[order]):
        blocks.append([float(t), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            for i in range(3):
                blocks[-1][i] += last[i]
    prior = float(y.mean())
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.maximum.accumulate(np.array([(b[0] + prior) / (b[1] + 1) for b in blocks])))
