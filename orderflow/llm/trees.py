"""Small regression trees on binned features: the learner of the quality models.

Runs on a bounded labelled sample (see ``docstats.labelled_sample``). A tree is
kept as flat node arrays, so scoring is a few vectorised gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Nodes:
    """Trees as parallel arrays; a leaf is its own child. ``x <= threshold`` goes left."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of each feature: midpoints between neighbouring quantile values."""
    out = []
    for col in x.T:
        v = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1))) if len(col) else np.zeros(0)
        seen = np.unique(col)
        nxt = seen[np.minimum(np.searchsorted(seen, v, "right"), max(len(seen) - 1, 0))] if len(seen) else v
        out.append(np.unique(((v + nxt) / 2)[nxt > v]))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0,
          least: float = 2.0, monotone: dict[int, int] | None = None, share: float = 1.0, seed: int = 7) -> Nodes:
    """Gradient-boosted logistic trees.

    ``monotone[f] = -1`` makes the score fall (never rise) with feature f, +1
    makes it rise: a split that breaks the order is refused, and both sides'
    leaves keep to their side of the split's middle value. ``share`` is the
    part of the sample that each tree sees, chosen by a seeded generator.
    """
    monotone, rng = monotone or {}, np.random.default_rng(seed)
    cuts = cut_points(x)
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    p0 = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), base)
    f, t, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(f)
        f.append(0), t.append(0.0), left.append(k), right.append(k), value.append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        weight = lambda a, b: float(np.clip(-a / (b + ridge), low, high))
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if level < depth and len(rows):
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, k], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, k], h[rows], len(c) + 1))[:-1]
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain = np.where((hl >= least / 4) & (hs - hl >= least / 4), gain, -1)
                if k in monotone:
                    gain = np.where(monotone[k] * (wr - wl) >= 0, gain, -1)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), k, j)
        if best[1] < 0:
            return leaf(rate * weight(gs, hs))
        _, k, j = best
        goes = binned[rows, k] <= j
        a, b = rows[goes], rows[~goes]
        middle = (weight(g[a].sum(), h[a].sum()) + weight(g[b].sum(), h[b].sum())) / 2
        sign = monotone.get(k, 0)
        at = leaf(rate * weight(gs, hs))
        l_id = grow(a, g, h, level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
        r_id = grow(b, g, h, level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
        f[at], t[at], left[at], right[at] = k, float(cuts[k][j]), l_id, r_id
        return at

    for _ in range(rounds if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < share) if share < 1 else np.arange(len(y))
        roots.append(grow(rows, p - y, np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
        now = _nodes(f, t, left, right, value, [roots[-1]], depth, 0.0)
        margin = margin + now.margin(x)
    return _nodes(f, t, left, right, value, roots, depth, base)


def _nodes(f, t, left, right, value, roots, depth, base) -> Nodes:
    return Nodes(np.array(f, int), np.array(t, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), depth, base)
