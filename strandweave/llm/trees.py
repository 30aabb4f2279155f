"""Decision trees in numpy: histogram splits, flat node arrays, vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Trees of one depth as complete binary trees: node i has children 2i+1 and 2i+2; leaves follow the inner nodes."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); go left if x <= threshold
    value: np.ndarray  # (trees, leaves)
    depth: int
    base: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """base plus the sum of leaf values, row by row of x."""
        x = np.asarray(x, np.float64)
        tree, inner = np.arange(len(self.feature))[None, :], (1 << self.depth) - 1
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.value[tree, node - inner].sum(axis=1)


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)


def grow(b: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, l2: float, least: float, monotone: np.ndarray, features: np.ndarray | None = None, rng=None, per_node: int = 0):
    """One tree on binned rows by second-order gain. monotone holds -1, 0 or 1 per feature; bounds pass down so that leaves obey it."""
    inner = (1 << depth) - 1
    feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    node = np.zeros(len(b), np.int64)
    bounds = {0: (-np.inf, np.inf)}
    n_bins = max((len(e) for e in edges), default=0) + 1
    width = b.shape[1]
    offset = np.arange(width) * n_bins
    for i in range(inner):
        low, high = bounds[i]
        rows = np.flatnonzero(node == i)
        mid = None
        if len(rows):
            flat = (b[rows] + offset).ravel()
            g = np.bincount(flat, np.repeat(grad[rows], width), n_bins * width).reshape(width, n_bins).cumsum(1)
            h = np.bincount(flat, np.repeat(hess[rows], width), n_bins * width).reshape(width, n_bins).cumsum(1)
            gt, ht = g[:, -1:], h[:, -1:]
            vl, vr = (np.clip(-a / (c + l2), low, high) for a, c in ((g, h), (gt - g, ht - h)))
            worth = lambda v, a, c: -(a * v + 0.5 * (c + l2) * v * v)
            gain = worth(vl, g, h) + worth(vr, gt - g, ht - h) - worth(np.clip(-gt / (ht + l2), low, high), gt, ht)
            gain[(h < least) | (ht - h < least) | (monotone[:, None] * (vr - vl) < 0)] = -np.inf
            gain[:, -1] = -np.inf
            for f, e in enumerate(edges):
                gain[f, len(e) :] = -np.inf
            if per_node:
                out = np.ones(width, bool)
                out[rng.choice(width, min(per_node, width), replace=False)] = False
                gain[out] = -np.inf
            f, k = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, k] > 1e-9:
                feature[i], threshold[i] = f, edges[f][k]
                mid = (vl[f, k] + vr[f, k]) / 2
                node[rows] = 2 * i + 1 + (b[rows, f] > k)
                m = monotone[f]
                bounds[2 * i + 1] = (low, min(high, mid)) if m > 0 else (max(low, mid), high) if m < 0 else (low, high)
                bounds[2 * i + 2] = (max(low, mid), high) if m > 0 else (low, min(high, mid)) if m < 0 else (low, high)
        if mid is None:
            node[rows] = 2 * i + 1
            bounds[2 * i + 1] = bounds[2 * i + 2] = (low, high)
    leaf = node - inner
    g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
    low, high = (np.array([bounds[inner + j][s] for j in range(inner + 1)]) for s in (0, 1))
    value = np.clip(-g / (h + l2), low, high)
    return feature, threshold, value, leaf


def boost(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic gradient boosting; scores are log odds."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    edges = bin_edges(x)
    b = binned(x, edges)
    raw = np.full(len(y), base)
    found = []
    for _ in range(trees if len(set(y.tolist())) > 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        f, t, v, leaf = grow(b, edges, p - y, p * (1 - p), depth, l2, least / 4, monotone)
        raw += rate * v[leaf]
        found.append((f, t, rate * v))
    inner = (1 << depth) - 1
    if not found:
        found = [(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1))]
    return Forest(*(np.stack(c) for c in zip(*found)), depth, base)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 6, seed: int = 7) -> Forest:
    """Bagged trees on square-root feature subsets; scores are the mean share of label 1."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    rng = np.random.default_rng(seed)
    edges = bin_edges(x)
    b = binned(x, edges)
    per_node = max(1, round(x.shape[1] ** 0.5))
    zero = np.zeros(x.shape[1])
    found = []
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        f, t, v, _ = grow(b, edges, -w * y, w, depth, 1e-6, 1.0, zero, rng=rng, per_node=per_node)
        found.append((f, t, v / trees))
    return Forest(*(np.stack(c) for c in zip(*found)), depth)
