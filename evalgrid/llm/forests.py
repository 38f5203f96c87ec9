"""Tree ensembles in numpy: histogram gradient boosting and isolation forest.

Both are flattened into arrays of complete binary trees, so that a batch of
rows walks all trees level by level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: inner nodes (trees, 2**depth - 1) and leaves (trees, 2**depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def places(self, x: np.ndarray) -> np.ndarray:
        """Which leaf, (rows, trees): at each node right if the feature is above the threshold."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return at - inner

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf values, (rows, trees)."""
        return self.leaf[np.arange(len(self.feature)), self.places(x)]


@dataclass
class Boosted:
    trees: Trees
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-(self.base + self.trees.leaves(x).sum(axis=1)))) if len(x) else np.zeros(0)


#: Bins of a feature, and the unit of gradients: sums of its multiples are exact in any order.
BINS, UNIT = 128, 2.0**-26


@dataclass
class Splits:
    """Trees of a growing model over binned features: right if the bin's number is above ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def step(self, binned: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node at which each row of ``binned`` (features, rows) is after ``levels`` cuts."""
        at, row = np.zeros(binned.shape[1], np.int64), np.arange(binned.shape[1])
        for _ in range(levels):
            at = 2 * at + 1 + (binned[self.feature[tree, at], row] > self.cut[tree, at])
        return at

    def advanced(self, binned: np.ndarray, margin: np.ndarray | None, done: int, trees: int) -> np.ndarray:
        """The rows' margin after ``trees`` trees, given that after ``done`` of them."""
        margin = np.full(binned.shape[1], self.base) if margin is None else margin
        inner = self.feature.shape[1]
        for t in range(done, trees):
            margin = margin + self.leaf[t][self.step(binned, t, (inner + 1).bit_length() - 1) - inner]
        return margin

    def histograms(self, binned: np.ndarray, y: np.ndarray, margin: np.ndarray, tree: int, level: int) -> np.ndarray:
        """Sums of gradients and Hessians in units, (2, nodes of the level, features, ``BINS``)."""
        p = 1 / (1 + np.exp(-margin))
        parts = np.rint((p - y) / UNIT), np.rint(p * (1 - p) / UNIT)
        first, count = (1 << level) - 1, 1 << level
        cell = (self.step(binned, tree, level) - first) * BINS
        out = np.empty((2, count, len(binned), BINS))
        for f, column in enumerate(binned):
            for i, part in enumerate(parts):
                out[i, :, f] = np.bincount(cell + column, part, count * BINS).reshape(count, BINS)
        return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of rows of features, (features, rows)."""
    return np.array([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], np.uint8).reshape(len(cuts), len(x))


def quantile_cuts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """At most ``BINS`` - 1 cuts of the ascending ``values`` into bins of about equal counts."""
    marks = np.linspace(0, 1, BINS + 1)[1:-1] * counts.sum()
    return np.unique(values[np.searchsorted(np.cumsum(counts), marks)]) if len(values) else np.zeros(0)


def grow_boosted(
    cuts: list[np.ndarray], share: float, histograms: Callable[[Splits, int, int], np.ndarray], rounds: int = 120, depth: int = 4,
    rate: float = 0.1, ridge: float = 1.0, least: float = 5.0,
) -> Boosted:
    """Gradient boosting of log loss with histogram splits (second order, ridge penalty).

    ``share``: rate of label 1. ``histograms``: what ``Splits.histograms``
    gives for the splits so far, a tree and a level, summed over all rows.
    ``least``: the least sum of Hessians in a leaf times four.
    """
    inner, n_leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((rounds, inner), np.int64)
    splits = Splits(feature, np.full((rounds, inner), BINS), np.zeros((rounds, n_leaves)), float(np.log(share / (1 - share))))
    threshold = np.full((rounds, inner), np.inf)
    for r in range(rounds):
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            gs, hs = histograms(splits, r, level) * UNIT
            gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
            gt, ht = gs.sum(2, keepdims=True), hs.sum(2, keepdims=True)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
            gain = gain.reshape(count, -1)
            for c, best in enumerate(gain.argmax(1)):
                f, at = divmod(int(best), BINS - 1)
                g, h = np.array([gt[c, 0, 0], 0]), np.array([ht[c, 0, 0], 0])
                if gain[c, best] > 1e-6:
                    feature[r, first + c], splits.cut[r, first + c], threshold[r, first + c] = f, at, cuts[f][at]
                    g, h = (np.array([below[c, f, at], all_[c, f, 0] - below[c, f, at]]) for below, all_ in ((gl, gt), (hl, ht)))
                if level == depth - 1:
                    splits.leaf[r, 2 * c : 2 * c + 2] = -rate * g / (h + ridge)
    return Boosted(Trees(feature, threshold, splits.leaf), splits.base)


def constant(share: float, depth: int = 4) -> Boosted:
    """The model that answers ``share``."""
    inner, n_leaves = (1 << depth) - 1, 1 << depth
    return Boosted(Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, n_leaves))), float(np.log(share / (1 - share))))


def fit_boosted(x: np.ndarray, y: np.ndarray, **options) -> Boosted:
    """``grow_boosted`` on rows at hand. Without rows of both labels the model answers their rate."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) == 0 or y.min() == y.max():
        return constant(share)
    cuts = [quantile_cuts(*np.unique(c, return_counts=True)) for c in x.T]
    bins = binned(x, cuts)
    kept: dict[int, np.ndarray] = {}

    def histograms(splits: Splits, tree: int, level: int) -> np.ndarray:
        if tree not in kept:
            margin = splits.advanced(bins, kept.pop(tree - 1, None), max(tree - 1, 0), tree)
            kept[tree] = margin
        return splits.histograms(bins, y, kept[tree], tree, level)

    return grow_boosted(cuts, share, histograms, **options)


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Isolation:
    trees: Trees
    scale: float
    #: Cuts on the way to each leaf, (trees, leaves).
    level: np.ndarray

    def recounted(self, counts: np.ndarray) -> Isolation:
        """The forest with the path lengths of the rows counted in each leaf, instead of those the trees were grown on."""
        return Isolation(replace(self.trees, leaf=self.level + _path(counts)), max(float(_path(counts[0].sum())), 1.0), self.level)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 to the minus mean path length over its expectation."""
        return 2.0 ** (-self.trees.leaves(x).mean(axis=1) / self.scale) if len(x) else np.zeros(0)


def fit_isolation(x: np.ndarray, trees: int = 200, rows: int = 256, seed: int = 11) -> Isolation:
    """Isolation forest: each tree splits ``rows`` random rows of ``x`` at random values of random features.

    The few rows of a tree are the method's own: in all rows at once anomalies
    that are near each other would hide one another.
    """
    x = np.asarray(x, np.float64)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    inner, n_leaves = (1 << depth) - 1, 1 << depth
    rng = np.random.default_rng(seed)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf, levels = np.zeros((trees, n_leaves)), np.zeros((trees, n_leaves))
    for t in range(trees):
        sample = x[rng.choice(len(x), rows, replace=False)] if rows else x
        members = {0: np.arange(rows)}
        stopped: dict[int, tuple[int, int]] = {}  # level and rows where a branch ends above the last one
        for node in range(inner):
            m = members.pop(node, None)
            level = (node + 1).bit_length() - 1
            if node in stopped or m is None or len(m) <= 1:
                stopped[2 * node + 1] = stopped[2 * node + 2] = stopped.get(node, (level, 0 if m is None else len(m)))
                continue
            lo, hi = sample[m].min(0), sample[m].max(0)
            open_ = np.flatnonzero(hi > lo)
            if not len(open_):
                stopped[2 * node + 1] = stopped[2 * node + 2] = level, len(m)
                continue
            f = rng.choice(open_)
            cut = rng.uniform(lo[f], hi[f])
            feature[t, node], threshold[t, node] = f, cut
            right = sample[m, f] > cut
            members[2 * node + 1], members[2 * node + 2] = m[~right], m[right]
        for i in range(n_leaves):
            node = inner + i
            levels[t, i], held = stopped[node] if node in stopped else (depth, len(members.get(node, ())))
            leaf[t, i] = levels[t, i] + float(_path(held))
    return Isolation(Trees(feature, threshold, leaf), max(float(_path(rows)), 1.0), levels)
