"""Histogram gradient-boosted trees for a yes/no label, flattened for numpy.

Fitted on a bounded sample of rows by features. Each feature is cut at quantiles into at
most ``BINS`` bins; a split is chosen from the gradient sums of the bins. A fitted model
is four arrays in heap order per tree, so that a batch walks all trees level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Complete binary trees: ``feature`` and ``cut`` of the inner nodes, ``leaf`` values.

    A row goes right where its feature is above the cut; an inner node that was not split
    has an infinite cut.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row, between 0 and 1."""
        total = np.full(len(rows), self.base)
        everyone, inner = np.arange(len(rows)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), dtype=np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[everyone, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -50, 50)))


def fit_forest(
    rows: np.ndarray,
    label: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    smooth: float = 1.0,
    least: int = 5,
) -> Forest:
    """Boost ``trees`` trees of ``depth`` levels on the logistic loss.

    Without rows of both labels the score is the share of label 1 (one half without rows).
    """
    inner, leaves = 2**depth - 1, 2**depth
    share = (label.sum() + 0.5) / (len(label) + 1.0)
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((trees, inner), dtype=np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if len(label) == 0 or label.min() == label.max():
        return Forest(feature[:0], cut[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in rows.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, rows.T)], axis=1)
    width, features = BINS + 1, rows.shape[1]
    total = np.full(len(label), base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, curve = chance - label, chance * (1 - chance)
        node = np.zeros(len(label), dtype=np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            at = ((node - first)[:, None] * features + np.arange(features)) * width + binned
            shape = (here, features, width)
            sums = [
                np.bincount(at.ravel(), np.repeat(v, features), here * features * width).reshape(shape).cumsum(axis=2)
                for v in (slope, curve, np.ones(len(label)))
            ]
            whole = [s[:, :, -1:] for s in sums]
            rest = [w - s for w, s in zip(whole, sums)]
            gain = (
                sums[0] ** 2 / (sums[1] + smooth)
                + rest[0] ** 2 / (rest[1] + smooth)
                - whole[0] ** 2 / (whole[1] + smooth)
            )
            gain[(sums[2] < least) | (rest[2] < least)] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            for k in range(here):
                if gain.reshape(here, -1)[k, best[k]] > 1e-9:
                    f, b = divmod(int(best[k]), width)
                    feature[tree, first + k], cut[tree, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[tree, node]] > cut[tree, node])
        own = node - inner
        down, up = np.bincount(own, slope, leaves), np.bincount(own, curve, leaves)
        leaf[tree] = -rate * down / (up + smooth)
        total += leaf[tree][own]
    return Forest(feature, cut, leaf, base)
