"""Histogram gradient-boosted trees for binary labels, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees: node i has children 2i+1 and 2i+2; a row goes right where its feature exceeds the threshold."""

    feature: np.ndarray  #: (trees, inner nodes)
    threshold: np.ndarray  #: (trees, inner nodes); infinite where a node isn't split
    leaf: np.ndarray  #: (trees, leaves)
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 5) -> Forest:
    """Newton boosting of the logistic loss over quantile bins. Rows of a single label, or none: that label's smoothed rate."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)  # bin b: cuts[b-1] < value <= cuts[b]
    flat = binned + np.arange(width) * bins
    score, out = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(depth):
            low, many = (1 << level) - 1, 1 << level
            slot = ((node - low)[:, None] * (width * bins) + flat).ravel()
            g, h, c = (np.bincount(slot, np.repeat(w, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for w in (grad, hess, np.ones(n)))
            gt, ht, ct = (a[:, :1, -1:] for a in (g, h, c))
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[i, f, cut] > 1e-9 and cut < len(cuts[f]):
                    feature[low + i], threshold[low + i] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + l2)
        score += leaf[at]
        out.append((feature, threshold, leaf))
    return Forest(*(np.stack(a) for a in zip(*out)), base)
