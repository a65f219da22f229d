"""Gradient-boosted trees on histograms, as flat arrays that numpy walks for many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Trees of one depth as arrays (trees, nodes): node i has the children 2 i + 1 and 2 i + 2.

    A row goes to the second child where its ``feature`` is above the
    ``bound``; nodes that are not split have an endless bound. ``value`` holds
    the leaves (trees, 2 ** depth), ``constant`` is added to their sum.
    """

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    constant: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of each row's leaves and the constant: all trees go down a level at a time."""
        out = np.full(len(x), self.constant)
        trees, nodes = self.feature.shape
        each = np.arange(trees)[None, :]
        for start in range(0, len(x) if trees else 0, 4096):
            part = x[start : start + 4096]
            row, at = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
            for _ in range(nodes.bit_length()):
                at = 2 * at + 1 + (part[row, self.feature[each, at]] > self.bound[each, at])
            out[start : start + 4096] += self.value[each, at - nodes].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_bounds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 bounds, half-way between neighbouring values, that part the weight evenly."""
    order = np.argsort(values, kind="stable")
    v, upto = values[order], np.cumsum(weights[order])
    change = np.flatnonzero(v[1:] != v[:-1])
    if len(change) >= bins:
        wanted = upto[-1] * np.arange(1, bins) / bins
        change = np.unique(change[np.minimum(np.searchsorted(upto[change], wanted), len(change) - 1)])
    middle = (v[change] + v[change + 1]) / 2
    return np.where(middle < v[change + 1], middle, v[change])


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (nodes, features, bins) of gradients and curvatures: each node's best gain, its feature and its last bin on the left."""
    gl, hl = g.cumsum(2), h.cumsum(2)
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    gr, hr = gt - gl, ht - hl
    worth = lambda g, h: g**2 / np.maximum(h + ridge, 1e-300)
    gain = worth(gl, hl) + worth(gr, hr) - worth(gt, ht)
    gain = np.where((hl >= least) & (hr >= least), gain, 0.0)[:, :, :-1]
    flat = gain.reshape(len(g), -1)
    best = flat.argmax(1)
    return flat[np.arange(len(g)), best], best // gain.shape[2], best % gain.shape[2]


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Trees for the logistic loss by Newton steps; each level of a tree is chosen from histograms of all its nodes at once.

    ``weights`` are brought to a mean of 1. A split needs a curvature of
    ``least`` on either side and a positive gain; equal gains go to the first
    feature and bound.
    """
    rows, features = x.shape
    weights = weights / weights.mean()
    bounds = [bin_bounds(x[:, f], weights, bins) for f in range(features)]
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], 1)
    cells = binned + np.arange(features) * bins
    share = float(np.clip(weights @ y / weights.sum(), 1e-6, 1 - 1e-6))
    constant = float(np.log(share / (1 - share)))
    margin = np.full(rows, constant)
    nodes = (1 << depth) - 1
    feature, bound, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g, h = weights * (p - y), weights * np.maximum(p * (1 - p), 1e-12)
        at = np.zeros(rows, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            key = ((at - first) * (features * bins))[:, None] + cells
            sums = [np.bincount(key.ravel(), np.repeat(w, features), width * features * bins).reshape(width, features, bins) for w in (g, h)]
            gain, f, b = best_splits(*sums, ridge, least)
            for node in np.flatnonzero(gain > 1e-9).tolist():
                if b[node] < len(bounds[f[node]]):
                    feature[t, first + node], bound[t, first + node] = f[node], bounds[f[node]][b[node]]
            at = 2 * at + 1 + (x[np.arange(rows), feature[t, at]] > bound[t, at])
        leaf = at - nodes
        value[t] = -rate * np.bincount(leaf, g, nodes + 1) / np.maximum(np.bincount(leaf, h, nodes + 1) + ridge, 1e-300)
        margin += value[t, leaf]
    return Trees(feature, bound, value, constant)
