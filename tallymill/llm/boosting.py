"""Gradient boosted trees for two classes over small integer features, and a calibrated cut-off."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LEVELS = 3
TREES = 60
RATE = 0.3
BINS = 32
RIDGE = 1.0


@dataclass
class Trees:
    """Complete trees: at each level one (feature, cut) per node; right if the bin is over the cut."""

    bias: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    threshold: dict[str, float] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**LEVELS - 1)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """From features (rows, columns; 0 to BINS - 1) and labels 0/1, with a ridge penalty on the leaves."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    total = np.full(len(y), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        if np.abs(gradient).max() < 1e-3:
            break
        feature = np.zeros(2**LEVELS - 1, np.int64)
        cut = np.full(2**LEVELS - 1, BINS)
        node = np.zeros(len(y), np.int64)
        for level in range(LEVELS):
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == n)
                if len(rows) < 2:
                    continue
                best, found = 1e-6, None
                g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
                for j in range(x.shape[1]):
                    g = np.cumsum(np.bincount(x[rows, j], gradient[rows], BINS))[:-1]
                    h = np.cumsum(np.bincount(x[rows, j], hessian[rows], BINS))[:-1]
                    gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, found = gain[at], (j, at)
                if found:
                    feature[n], cut[n] = found
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaves = node - (2**LEVELS - 1)
        g = np.bincount(leaves, gradient, 2**LEVELS)
        h = np.bincount(leaves, hessian, 2**LEVELS)
        leaf = RATE * g / (h + RIDGE)
        model.trees.append((feature, cut, leaf))
        total += leaf[leaves]
    return model


def calibrate(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut-off (0.5 at least) from which on held-out rows reach ``precision``; 2.0, which nothing reaches, if none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order])
    share = right / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True) if len(y) else np.zeros(0, bool)
    good = np.flatnonzero(last & (share >= precision) & (scores[order] >= 0.5))
    return float(scores[order][good[-1]]) if len(good) else 2.0


def calibrate_bins(counts: list[tuple[int, int, int]], precision: float, per_logit: int) -> float:
    """As ``calibrate``, from (bin, negatives, positives) with bins of 1 / ``per_logit`` from logit 0 on; the cut-off is a bin's lower end."""
    best, wrong, right = 2.0, 0, 0
    for at, n, p in sorted(counts, reverse=True):
        wrong, right = wrong + n, right + p
        if right and right >= precision * (right + wrong):
            best = float(1 / (1 + np.exp(-at / per_logit)))
    return best
