"""Gradient-boosted trees with logistic loss over binned features, and isotonic calibration.

Fitted on the driver, on rows bounded by a parameter of the callers; a model is a few hundred
kilobytes at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Trees of one depth, as arrays of (tree, node); children of node i are 2i + 1 and 2i + 2."""

    depth: int
    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, lim, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > lim[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 3.0) -> Trees:
    """Newton boosting; splits are searched over quantile bins of each feature."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, d), int)
    p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score, inner = np.full(n, base), 2**depth - 1
    feature, limit, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    flat = code + np.arange(d) * bins
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * bins) + flat).reshape(-1)
            shape = (width, d, bins)
            gs = np.cumsum(np.bincount(at, np.repeat(g, d), width * d * bins).reshape(shape), 2)
            hs = np.cumsum(np.bincount(at, np.repeat(h, d), width * d * bins).reshape(shape), 2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
            for k in range(width):
                j, b = np.unravel_index(gain[k].argmax(), (d, bins))
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + k], limit[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > limit[t][node])
        slot = node - inner
        leaf[t] = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + l2)
        score += leaf[t][slot]
    return Trees(depth, base, feature, limit, leaf)


@dataclass
class Isotonic:
    """A rising step function between calibrated points, straight in between."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal scores are pooled first."""
    if not len(raw):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    at, inverse = np.unique(raw, return_inverse=True)
    mean, weight = np.bincount(inverse, y) / np.bincount(inverse), np.bincount(inverse).astype(float)
    pools: list[list[float]] = []  # mean, weight, first, last
    for i, (m, w) in enumerate(zip(mean, weight)):
        pools.append([m, w, i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, _, last = pools.pop()
            m1, w1, first, _ = pools[-1]
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last]
    x = np.array([(at[a] + at[b]) / 2 for _, _, a, b in pools])
    return Isotonic(x, np.array([m for m, *_ in pools]))


@dataclass
class Calibrated:
    """A score is 98 % the curve's and 2 % the trees' own probability, which orders its steps."""

    trees: Trees
    curve: Isotonic
    unseen: np.ndarray | None = None  #: raw scores of the fitted rows by trees that have not seen them

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        return np.clip(0.98 * self.curve(raw) + 0.02 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: int = 3, seed: int = 7, features=None, taught=None, **how) -> Calibrated:
    """Trees on all rows, and a curve fitted to scores of rows that their trees have not seen.

    features(train_rows, rows), if given, replaces x: it makes features of rows from what
    may be learnt of train_rows. taught (x, y), if given, are more rows for the trees, those
    behind the curve's scores too; the curve is fitted to the rows of x alone.
    """
    def with_taught(x, y):
        return (x, y) if taught is None else (np.concatenate([x, taught[0]]), np.concatenate([y, taught[1]]))

    n = len(y)
    fold = np.random.default_rng(seed).permutation(n) % folds if n else np.zeros(0, int)
    raw = np.zeros(n)
    whole = x
    if features is not None:
        made = [(test, features(np.flatnonzero(fold != k), test)) for k in range(folds) for test in [np.flatnonzero(fold == k)]]
        whole = np.zeros((n, made[0][1].shape[1]))
        for test, seen in made:
            whole[test] = seen
    for k in range(folds):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(train) and len(test):
            raw[test] = fit_trees(*with_taught(whole[train], y[train]), **how).raw(whole[test])
    return Calibrated(fit_trees(*with_taught(whole, y), **how), fit_isotonic(raw, y), raw)
