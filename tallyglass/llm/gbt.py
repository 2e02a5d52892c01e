"""Small gradient-boosted trees and isotonic calibration on numpy arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over quantile bins.

    Trees are complete: node i has children 2i+1 and 2i+2; a node that did not split
    sends all rows left.
    """

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: int = 8, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.l2 = rounds, depth, rate, bins, leaf, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            feat, thr, value = np.full(inner, -1), np.zeros(inner), np.zeros(2 * inner + 1)
            node = np.zeros(n, int)
            for i in range(inner):
                rows = np.flatnonzero(node == i)
                if not len(rows):
                    continue
                best = self._split(binned[rows], g[rows], h[rows], cuts)
                if best:
                    feat[i], thr[i] = best
                    right = x[rows, feat[i]] > thr[i]
                else:
                    right = np.zeros(len(rows), bool)
                node[rows] = 2 * i + 1 + right
            gs, hs = np.bincount(node, g, 2 * inner + 1), np.bincount(node, h, 2 * inner + 1)
            value = -self.rate * gs / (hs + self.l2)
            f += value[node]
            self.trees.append((feat, thr, value))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
        best, found = 1e-6, None
        gt, ht, n = g.sum(), h.sum(), len(g)
        if n < 2 * self.leaf:
            return None
        whole = gt * gt / (ht + self.l2)
        for j, c in enumerate(cuts):
            m = len(c) + 1
            if m < 2:
                continue
            gl, hl, nl = (np.cumsum(np.bincount(b[:, j], w, m))[:-1] for w in (g, h, None))
            gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - whole
            gain[(nl < self.leaf) | (n - nl < self.leaf)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, float(c[k]))
        return found

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feat, thr, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feat[node]
                node = 2 * node + 1 + ((j >= 0) & (x[at, np.maximum(j, 0)] > thr[node]))
            f += value[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns the blocks' mean scores and mean labels."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Calibrated:
    """Boosted trees whose scores are mapped to rates by isotonic regression.

    The map is fitted on out-of-fold scores and interpolated between its blocks, with a
    small slope added so that scores keep their order.
    """

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Calibrated:
        self.flat = float(y.mean()) if len(y) else 0.0
        if len(y) < 40 or min(y.sum(), len(y) - y.sum()) < 5:
            self.model = None
            return self
        out = np.zeros(len(y))
        for k in range(3):
            test = fold % 3 == k
            if test.any() and 0 < y[~test].sum() < (~test).sum():
                out[test] = Boosted().fit(x[~test], y[~test]).raw(x[test])
        self.xs, self.ys = isotonic(out, y)
        self.model = Boosted().fit(x, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.flat)
        raw = self.model.raw(x)
        soft = 1 / (1 + np.exp(-raw))
        return np.clip(0.999 * np.interp(raw, self.xs, self.ys) + 0.001 * soft, 0, 1)
