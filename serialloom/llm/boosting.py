"""Gradient-boosted regression trees for a yes/no label, in numpy."""

import numpy as np

BINS = 24


class Trees:
    """Trees of one depth: per tree and inner node a feature and a threshold, per leaf a value."""

    def __init__(self, base: float, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray):
        self.base, self.features, self.cuts, self.leaves = base, features, cuts, leaves
        self.depth = int(np.log2(leaves.shape[1])) if len(leaves) else 0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, features[at]] > cuts[at])
            total += leaves[at - len(features)]
        return total


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, share: float = 0.5, seed: int = 3
) -> Trees:
    """Logistic loss; each tree looks at a share of the features, cut at quantiles."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.int64)
    usable = np.array([f for f in range(x.shape[1]) if binned[:, f].min() < binned[:, f].max()])
    prior = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), base)
    all_features, all_cuts, all_leaves = [], [], []
    inner = 2**depth - 1
    for _ in range(rounds if len(usable) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        picked = rng.choice(usable, max(1, int(len(usable) * share)), replace=False)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            here = at - first
            best = np.full(n, 1e-3)
            for f in picked:
                k = len(edges[f]) + 1
                cell = here * k + binned[:, f]
                gs = np.bincount(cell, g, n * k).reshape(n, k).cumsum(axis=1)
                hs = np.bincount(cell, h, n * k).reshape(n, k).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = gain[:, :-1]
                top = gain.argmax(axis=1)
                better = gain[np.arange(n), top] > best
                best = np.where(better, gain[np.arange(n), top], best)
                features[first : first + n][better] = f
                cuts[first : first + n][better] = edges[f][top[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), features[at]] > cuts[at])
        leaf = at - inner
        leaves = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += leaves[leaf]
        all_features.append(features)
        all_cuts.append(cuts)
        all_leaves.append(leaves)
    shape = (len(all_leaves), inner)
    return Trees(
        base, np.array(all_features, np.int64).reshape(shape), np.array(all_cuts).reshape(shape),
        np.array(all_leaves).reshape(len(all_leaves), inner + 1),
    )
