"""A generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Every feature is cut into quantile bins.  Boosting visits the features in turn; each visit fits a shallow tree on
one feature's histogram of gradients and adds a fraction of its leaves to that feature's lookup table.  The pairs
of features whose joint histogram explains most of the remaining gradient then get tables of their own, boosted
the same way.  Scoring is a sum of table entries, taken for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
PAIR_BINS = 12


@dataclass
class AdditiveModel:
    """Intercept, bin edges, one table per feature, and tables of chosen pairs."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        used = {f for a, b, _ in self.pairs for f in (a, b)}
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in used}
        for a, b, table in self.pairs:
            z += table[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram (cut k: bins below k to the left)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gr, hr = gt - gl, ht - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2), 0.0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: float) -> np.ndarray:
    """Leaf values of a tree of the given depth over the bins of one feature."""
    gain, k = _split(g, h, l2, least)
    if depth == 0 or gain <= 1e-12:
        return np.full(len(g), g.sum() / (h.sum() + l2))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, l2, least), _tree(g[k:], h[k:], depth - 1, l2, least)])


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> np.ndarray:
    """Leaf values over a two-feature histogram: a cut on one feature, then a cut on the other on either side."""
    best, leaves = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, k = _split(a.sum(1), b.sum(1), l2, least)
        out, worth = np.zeros_like(a), 0.0
        for part in (slice(0, k), slice(k, None)):
            if b[part].size == 0:
                continue
            row = _tree(a[part].sum(0), b[part].sum(0), 1, l2, least)
            out[part] = row
            worth += float((row * a[part].sum(0)).sum())
        if worth > best:
            best, leaves = worth, (out.T if flip else out)
    return leaves


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 120,
    pair_rounds: int = 40,
    n_pairs: int = 6,
    rate: float = 0.15,
    l2: float = 2.0,
    least: float = 1.0,
) -> AdditiveModel:
    """Fit on rows ``x`` with labels ``y`` (0 or 1).  No rows give probability 0.5; one class gives its smoothed rate."""
    n, width = x.shape
    mean = (y.sum() + 1.0) / (n + 2.0)
    edges = [_edges(x[:, f], BINS) if n else np.zeros(0) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    pair_edges = [_edges(x[:, f], PAIR_BINS) if n else np.zeros(0) for f in range(width)]
    model = AdditiveModel(float(np.log(mean / (1 - mean))), edges, tables, pair_edges, [])
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    z = np.full(n, model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(width):
            g, h = gradient()
            size = len(tables[f])
            leaves = rate * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), 2, l2, least)
            tables[f] += leaves
            z += leaves[bins[f]]
    coarse = [np.searchsorted(pair_edges[f], x[:, f], side="right") for f in range(width)]
    shape = [len(e) + 1 for e in pair_edges]

    def joint(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * shape[b] + coarse[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = gradient()
    worth = []
    for a in range(width):
        for b in range(a + 1, width):
            ga, ha = joint(a, b, g), joint(a, b, h)
            worth.append((float((_pair_tree(ga, ha, l2, least) * ga).sum()), a, b))
    chosen = sorted(worth, key=lambda w: (-w[0], w[1], w[2]))[:n_pairs]
    model.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in chosen]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = gradient()
            leaves = rate * _pair_tree(joint(a, b, g), joint(a, b, h), l2, least)
            table += leaves
            z += leaves[coarse[a], coarse[b]]
    return model
