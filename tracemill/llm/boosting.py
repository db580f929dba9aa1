"""Small gradient-boosted trees in numpy, for tables that fit one process."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in order; a leaf has feature -1 and its value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            goes_left = x[rows, self.feature[node]] <= self.cut[node]
            at[rows] = np.where(goes_left, self.left[node], self.right[node])
        return self.value[at]


def _grow(x, gradient, hessian, cuts, depth, least, penalty) -> Tree:
    nodes: list[list[float]] = []

    def add(rows, level):
        me = len(nodes)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        nodes.append([-1, 0.0, -1, -1, -g / (h + penalty)])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, None, None)
        for f, places in enumerate(cuts):
            if not len(places):
                continue
            bins = np.searchsorted(places, x[rows, f], "left")
            gs = np.cumsum(np.bincount(bins, gradient[rows], len(places) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins, hessian[rows], len(places) + 1))[:-1]
            ns = np.cumsum(np.bincount(bins, minlength=len(places) + 1))[:-1]
            gain = gs**2 / (hs + penalty) + (g - gs) ** 2 / (h - hs + penalty) - g**2 / (h + penalty)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, places[k])
        if best[1] is not None:
            goes_left = x[rows, best[1]] <= best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = add(rows[goes_left], level + 1)
            nodes[me][3] = add(rows[~goes_left], level + 1)
        return me

    add(np.arange(len(x)), 0)
    columns = list(zip(*nodes, strict=True))
    return Tree(np.array(columns[0], int), np.array(columns[1]), np.array(columns[2], int), np.array(columns[3], int), np.array(columns[4]))


@dataclass
class Boosted:
    """Sum of trees on the logit; ``slope`` and ``offset`` calibrate it."""

    base: float
    trees: list[Tree]
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.offset, -40, 40)))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 3, least: int = 5, penalty: float = 1.0, bins: int = 24) -> Boosted:
    """Second-order boosting on the logistic loss with histogram splits."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [])
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= bins else np.unique(np.quantile(middle, np.linspace(0, 1, bins))))
    logits = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logits))
        tree = _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), cuts, depth, least, penalty)
        tree.value *= rate
        model.trees.append(tree)
        logits += tree(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on rows the trees did not see, by a few Newton steps with a weak pull to slope 1."""
    z = np.clip(model.logits(x), -20, 20)
    slope, offset = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * z).sum() + (slope - 1), (p - y).sum() + 0.1 * offset])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
    model.slope, model.offset = float(max(slope, 0.1)), float(offset)
