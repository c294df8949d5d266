"""Histogram gradient-boosted trees for a binary label, and isotonic calibration, in numpy.

Training rows are few by contract (their callers take a bounded sample); scoring runs inside Spark tasks. Trees are
complete binary trees in heap order, kept as flat arrays, so that a batch goes down one level of a tree in a few array
operations.
"""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, base: float, depth: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.depth, self.feature, self.cut, self.leaf = base, depth, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: float = 5) -> Trees:
    """``x``: (rows, features); ``y``: 0 or 1. No rows, or one label only, give the constant log-odds."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    n, cols = x.shape
    inner = 2**depth - 1
    rate_of_ones = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(cols)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        width = bins + 1
        z = np.full(n, base)
        offset = np.arange(cols) * width
        for _ in range(trees):
            p = sigmoid(z)
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                nodes, first = 2**level, 2**level - 1
                key = (((at - first) * cols)[:, None] * width + offset + binned).ravel()
                shape = (nodes, cols, width)
                gs = np.bincount(key, np.repeat(g, cols), nodes * cols * width).reshape(shape).cumsum(2)
                hs = np.bincount(key, np.repeat(h, cols), nodes * cols * width).reshape(shape).cumsum(2)
                cs = np.bincount(key, minlength=nodes * cols * width).reshape(shape).cumsum(2)
                gt, ht, ct = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(cs < min_rows) | (ct - cs < min_rows)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                for k in range(nodes):
                    j, b = divmod(int(best[k]), width)
                    if gain[k, j, b] > 1e-9:
                        feature[first + k], cut[first + k] = j, cuts[j][b] if b < len(cuts[j]) else np.inf
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
            k = at - inner
            leaf = -rate * np.bincount(k, g, inner + 1) / (np.bincount(k, h, inner + 1) + l2)
            z += leaf[k]
            made.append((feature, cut, leaf))
    stacked = [np.stack(part) for part in zip(*made, strict=True)] if made else [np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))]
    return Trees(base, depth, *stacked)


class Isotonic:
    """Non-decreasing map from margin to probability by pool-adjacent-violators, linear between block centres."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, of margins, rows
        for m, t in zip(np.asarray(margin, float)[order], np.asarray(y, float)[order], strict=True):
            blocks.append([t, m, 1.0])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([m / n for _, m, n in blocks])
        # One row more on the side of the doubt keeps both ends inside (0, 1).
        self.y = np.maximum.accumulate(np.array([(t + 0.5 * t / n) / (n + 0.5) if t < n else (t + 0.5) / (n + 1) for t, _, n in blocks])) if blocks else np.zeros(0)

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y) if len(self.x) else sigmoid(margin)
