"""Gradient-boosted trees: fitted on a bounded sample on the driver, scored as a native column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float):
    """A tree as nested ``(feature, cut, left, right)``, its leaves as floats; ties go to the first split."""
    leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 8:
        return leaf
    base, best = g[rows].sum() ** 2 / (h[rows].sum() + 1.0), None
    for f in range(x.shape[1]):
        v = x[rows, f]
        levels = np.unique(v)
        for cut in levels[:-1][:: max(1, len(levels) // 24)]:
            left = v <= cut
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            gain = gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0) - base
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, float(cut), left)
    if best is None:
        return leaf
    _, f, cut, left = best
    return f, cut, _grow(x, g, h, rows[left], depth - 1, rate), _grow(x, g, h, rows[~left], depth - 1, rate)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _apply(left, x), _apply(right, x))


#: Width of the bins of scores from which the threshold is calibrated, and how many there are on either side of 0.
BIN, BINS = 1 / 64, 1024


class Boosted:
    """Logistic boosting; ``cut`` is the score from which spans are selected, infinite until it is calibrated."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3):
        self.trees, self.start, self.cut = [], 0.0, float("inf")
        if len(y) < 20 or not 0 < y.mean() < 1:
            return
        y = y.astype(float)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            p = _sigmoid(score)
            tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            score += _apply(tree, x)

    def bin(self, features: Column) -> Column:
        """The bin of the score of an array column of features."""
        return F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(self.column(features) / BIN))).cast("int")

    def calibrate(self, bins: dict[int, tuple[int, int]], precision: float = 0.9) -> None:
        """From how many candidates each bin has, and how many of these are positive: ``cut`` becomes
        the lowest score above which ``precision`` of them are."""
        n = right = 0
        for at in sorted(bins, reverse=True):
            n, right = n + bins[at][0], right + bins[at][1]
            if right >= precision * n:
                self.cut = at * BIN

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: Column) -> Column:
        """The score of an array column of features."""

        def node(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, left, right = tree
            return F.when(F.get(features, F.lit(f)) <= cut, node(left)).otherwise(node(right))

        out = F.lit(self.start)
        for tree in self.trees:
            out = out + node(tree)
        return out
