"""Gradient-boosted trees in numpy: trained level by level over histograms, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in one set of arrays; a leaf points to itself. ``roots`` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``; every tree of every row goes one level down at a time."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            go_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go_left, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic loss; ``monotone`` has +1, -1 or 0 for each feature: the score may only rise, only fall, or do either.

    A split that breaks a constraint is not taken, and both sides' leaves keep to their side of the middle between the
    two children's values, so whole trees are monotonic.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(v)
        return k

    margin = np.full(len(y), base)
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        root = add(0.0)
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for level in range(depth + 1):
            below = []
            for k, rows, low, high in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = rate * float(np.clip(gs / (hs + l2), low, high))
                best = None
                for f in range(x.shape[1]) if level < depth and len(rows) > 1 else ():
                    n = len(edges[f]) + 1
                    gl, hl = (np.cumsum(np.bincount(binned[rows, f], w[rows], n))[:-1] for w in (g, h))
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                    gain = gl * vl - (hl + l2) * vl**2 / 2 + gr * vr - (hr + l2) * vr**2 / 2
                    gain[(hl < least) | (hr < least) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                    if len(gain) and (best is None or gain.max() > best[0]):
                        s = int(gain.argmax())
                        best = (gain[s], f, s, vl[s], vr[s])
                v = float(np.clip(gs / (hs + l2), low, high))
                if best is None or not best[0] > gs * v - (hs + l2) * v**2 / 2 + 1e-6:
                    continue
                _, f, s, vl, vr = best
                feature[k], threshold[k], left[k], right[k] = f, float(edges[f][s]), add(0.0), add(0.0)
                side, mid = binned[rows, f] <= s, (vl + vr) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[f])]
                below += [(left[k], rows[side], *bounds[0]), (right[k], rows[~side], *bounds[1])]
            open_nodes = below
        one = Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array([root]), depth, 0.0)
        margin = margin + one.margin(x)
    return Forest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int64), depth, base)
