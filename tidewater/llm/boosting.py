"""Gradient-boosted trees for a binary label, small enough to fit on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: per tree and inner node a feature and a threshold, per leaf a value."""

    features: np.ndarray  # trees x (2 ** depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x 2 ** depth
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for each row of x."""
        out = np.full(len(x), self.start)
        depth = self.leaves.shape[1].bit_length() - 1
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over quantile bins, one level of all nodes at a time."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    inner = 2**depth - 1
    features = np.zeros((trees, inner), dtype=np.int64)
    thresholds = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                width = len(cut) + 1
                cell = (at - first) * width + coded[:, f]
                g = np.bincount(cell, grad, n * width).reshape(n, width).cumsum(axis=1)
                h = np.bincount(cell, hess, n * width).reshape(n, width).cumsum(axis=1)
                gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                top = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(n), top] > best)
                best[better] = gain[better, top[better]]
                features[t, first + better] = f
                thresholds[t, first + better] = cut[top[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), features[t, at]] > thresholds[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        leaves[t] = -rate * g / (h + ridge)
        margin += leaves[t, leaf]
    return Trees(features, thresholds, leaves, start)
