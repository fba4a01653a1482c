"""Gradient-boosted trees for a yes/no label on a bounded sample, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS, L2 = 40, 4, 0.3, 32, 1.0


@dataclass
class Boosted:
    """Complete trees of equal depth: feature and threshold per inner node, log-odds per leaf."""

    start: float
    features: np.ndarray  # trees x (2**depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x 2**depth

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Histogram trees on the logistic loss; deterministic."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    score = np.full(n, start)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    features, thresholds = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
    values = np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            nodes, base = 1 << level, (1 << level) - 1
            best = np.full(nodes, 1e-6)
            local = at - base
            for j in range(width):
                if not len(cuts[j]):
                    continue
                key = local * (BINS + 1) + binned[:, j]
                gs = np.bincount(key, g, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                hs = np.bincount(key, h, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs)**2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain = gain[:, :len(cuts[j])]
                cut = gain.argmax(axis=1)
                better = gain[np.arange(nodes), cut] > best
                for k in np.flatnonzero(better):
                    best[k] = gain[k, cut[k]]
                    features[t, base + k], thresholds[t, base + k] = j, cuts[j][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > thresholds[t, at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        values[t] = RATE * gs / (hs + L2)
        score += values[t, leaf]
    return Boosted(start, features, thresholds, values)
