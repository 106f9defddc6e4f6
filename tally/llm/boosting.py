"""Gradient-boosted trees for two classes, on binned features with numpy.

Trees grow from sums over weighted cases only: a case is a row of features with
the weights of its positive and its negative copies. Slopes and curvatures are
summed as integers, so the trees are the same wherever the cases lie and however
they are cut into parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Slopes and curvatures in this many parts of one; 2 ** 39 cases keep their sums in 63 bits.
UNIT = 1 << 24

#: A function of cases (x, positive, negative) gives key, value, one and two; cases that agree in key and value are summed.
Part = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def summed(key: np.ndarray, value: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that agree in key and value as one, with the sums of the others, in order."""
    order = np.lexsort((value, key))
    key, value, one, two = key[order], value[order], one[order], two[order]
    if not len(key):
        return key, value, one, two
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (value[1:] != value[:-1])])
    return key[first], value[first], np.add.reduceat(one, first), np.add.reduceat(two, first)


def values(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple:
    """How many cases have a value of a feature."""
    parts = [(np.full(len(x), f), x[:, f], positive, negative) for f in range(x.shape[1])]
    return summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))


@dataclass
class Boosted:
    """Trees of equal depth as arrays: the feature and threshold of each inner node, the value of each leaf."""

    depth: int = 3
    rate: float = 0.3
    rounds: int = 40
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, bins: int = 32, ridge: float = 1.0) -> Boosted:
        y = np.asarray(y).astype(np.int64)
        return self.fit_sums(lambda part: summed(*part(x, y, 1 - y)), bins, ridge)

    def fit_sums(self, sums: Callable[[Part], tuple], bins: int = 32, ridge: float = 1.0) -> Boosted:
        """Fit to cases that only ``sums`` reads: it gives the sums of a function over all of them."""
        key, value, positive, negative = sums(values)
        edges = []
        for f in range(int(key.max()) + 1):
            own, weight = value[key == f], (positive + negative)[key == f]
            some = np.searchsorted(weight.cumsum(), np.linspace(0, weight.sum(), bins + 1)[1:-1]) if len(own) > bins else np.arange(len(own) - 1)
            edges.append(own[np.unique(some)])
        share = np.clip(positive[key == 0].sum() / (positive + negative)[key == 0].sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        width = max(map(len, edges)) + 1
        for _ in range(self.rounds):
            chosen, cut, value = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf), np.zeros(2**self.depth)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                cells, _, slopes, bends = sums(self._histogram(edges, width, chosen, cut, level))
                g, h = np.zeros((2, len(edges) * n * width))
                g[cells], h[cells] = slopes / UNIT, bends / UNIT
                g, h = g.reshape(len(edges), n, width), h.reshape(len(edges), n, width)
                gt, ht = g[0].sum(1), h[0].sum(1)
                best, left = np.full(n, 1e-9), np.array([gt, ht]).T
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl, hl = g[f].cumsum(1)[:, : len(e)], h[f].cumsum(1)[:, : len(e)]
                    gain = gl**2 / (hl + ridge) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + ridge) - (gt**2 / (ht + ridge))[:, None]
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(n), at] > best):
                        best[k], chosen[first + k], cut[first + k], left[k] = gain[k, at[k]], f, e[at[k]], (gl[k, at[k]], hl[k, at[k]])
            value[0::2] = self.rate * left[:, 0] / (left[:, 1] + ridge)
            value[1::2] = self.rate * (gt - left[:, 0]) / (ht - left[:, 1] + ridge)
            self.trees.append((chosen, cut, value))
        return self

    def _histogram(self, edges: list[np.ndarray], width: int, chosen: np.ndarray, cut: np.ndarray, level: int) -> Part:
        """Sums of slopes and curvatures by feature, node of a level and bin, after the trees so far."""
        model = Boosted(self.depth, self.rate, self.rounds, self.base, list(self.trees))

        def part(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple:
            p, n = model.probability(x), 2**level
            slope = np.rint((1 - p) * UNIT).astype(np.int64) * positive - np.rint(p * UNIT).astype(np.int64) * negative
            bend = np.rint(p * (1 - p) * UNIT).astype(np.int64) * (positive + negative)
            node = _walk(x, chosen, cut, level)
            one, two = np.zeros((2, len(edges) * n * width), np.int64)
            for f, e in enumerate(edges):
                cell = (f * n + node) * width + np.searchsorted(e, x[:, f], "left")
                np.add.at(one, cell, slope)
                np.add.at(two, cell, bend)
            cells = np.flatnonzero(one | two)
            return cells, np.zeros(len(cells)), one[cells], two[cells]

        return part

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for chosen, cut, value in self.trees:
            total += value[_walk(x, chosen, cut, self.depth)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _walk(x: np.ndarray, chosen: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row so many levels down."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for level in range(levels):
        at = 2**level - 1 + node
        node = 2 * node + (x[rows, chosen[at]] > cut[at])
    return node
