"""Histogram trees on a bounded sample: the step inside a task of the ensemble's fits.

Features are binned once. A level of a tree is one histogram of gradient sums by (node, feature,
bin), and a tree is an array of nodes in heap order. Boosted trees follow the logistic loss;
forest trees hold the weighted share of positives among the bootstrap rows of a leaf.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Learner:
    """How a base learner grows."""

    trees: int
    depth: int
    rate: float = 0.05           # of boosting; 0: a forest
    rows: float = 0.8            # share of the rows that a boosted tree sees
    cols: float = 0.8            # share of the features that a tree (of a forest: a node) may use
    positive_weight: float = 0   # 0: balanced
    least: float = 1.0           # least sum of hessians (forest: weights) in a child


def bin_edges(x: np.ndarray) -> np.ndarray:
    """(features, BINS - 1) upper edges at quantiles; missing ones are infinite."""
    out = np.full((x.shape[1], BINS - 1), np.inf)
    for k in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        out[k, : len(edges)] = edges
    return out


def codes_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.int64)


def _go(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    node, at = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(depth):
        node = 2 * node + 1 + (codes[at, feature[node]] > cut[node])
    return node


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, allowed, penalty: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, value) of a tree's nodes. A node without a useful split sends all rows to the left."""
    n, d = codes.shape
    size = 2 ** (depth + 1) - 1
    feature, cut = np.zeros(size, np.int64), np.full(size, BINS, np.int64)
    node, at = np.zeros(n, np.int64), np.arange(n)
    column = np.arange(d) * BINS + codes
    gd, hd = np.repeat(g, d), np.repeat(h, d)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        key = ((node - first)[:, None] * (d * BINS) + column).ravel()
        left_g, left_h = (np.bincount(key, w, width * d * BINS).reshape(width, d, BINS).cumsum(2) for w in (gd, hd))
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
        gain = np.where((left_h >= least) & (right_h >= least) & allowed(width)[:, :, None], gain, -np.inf).reshape(width, -1)
        best = gain.argmax(1)
        good = np.flatnonzero(gain[np.arange(width), best] > 1e-9)
        feature[first + good], cut[first + good] = best[good] // BINS, best[good] % BINS
        node = 2 * node + 1 + (codes[at, feature[node]] > cut[node])
    total, weight = np.bincount(node, g, size), np.bincount(node, h, size)
    return feature, cut, np.divide(total, weight + penalty, out=np.zeros(size), where=weight > 0)


def fit(x: np.ndarray, y: np.ndarray, learner: Learner, seed: int) -> dict[str, np.ndarray]:
    """Node arrays (trees, nodes), bin edges and the constant part of a model of 0/1 labels ``y``."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    edges = bin_edges(x)
    codes = codes_of(x, edges)
    pos = float(y.sum())
    positive = learner.positive_weight or (n - pos) / max(pos, 1.0)
    weight = np.where(y == 1, positive, 1.0)
    few = max(1, round(learner.cols * d))
    trees, raw = [], np.zeros(n)
    for _ in range(learner.trees):
        if learner.rate:
            mask = np.isin(np.arange(d), rng.choice(d, few, replace=False))
            p = 1 / (1 + np.exp(-raw))
            some = np.flatnonzero(rng.random(n) < learner.rows)
            tree = grow(codes[some], (weight * (y - p))[some], (weight * p * (1 - p))[some], learner.depth, lambda w: np.broadcast_to(mask, (w, d)), 1.0, learner.least)
            raw += learner.rate * tree[2][_go(codes, *tree[:2], learner.depth)]
        else:
            times = np.bincount(rng.integers(0, n, n), minlength=n) * weight
            tree = grow(codes, times * y, times, learner.depth, lambda w: rng.random((w, d)).argsort(1) < few, 1e-9, learner.least)
        trees.append(tree)
    feature, cut, value = (np.stack(a) for a in zip(*trees))
    return {"edges": edges, "feature": feature.astype(np.int8), "cut": cut.astype(np.int8), "value": value * (learner.rate or 1 / learner.trees),
            "depth": np.array(learner.depth), "boosted": np.array(learner.rate > 0)}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    codes, out = codes_of(x, model["edges"]), np.zeros(len(x))
    for feature, cut, value in zip(model["feature"].astype(np.int64), model["cut"].astype(np.int64), model["value"]):
        out += value[_go(codes, feature, cut, int(model["depth"]))]
    return 1 / (1 + np.exp(-out)) if model["boosted"] else out


def to_bytes(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **model)
    return out.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}
