"""Gradient-boosted trees for a few dozen features, with isotonic calibration, from sums over bins.

The rows may lie in one array (`fit`) or in many tasks: `grow` asks for the sums of one level at a time, and whoever holds rows
adds up `sums` of their blocks. Gradients are summed as whole numbers and leaves are multiples of 1 / UNIT, so the model is
the same however the rows are spread and ordered, and scores have few values, by which rows are counted for calibration.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

#: Bins of a feature at most; no bin lies above the last.
BINS = 16
#: Leaves and starts are multiples of 1 / UNIT.
UNIT = 1 << 10
#: Gradients are summed in multiples of 1 / FINE: exact up to 2^29 rows, whatever their order.
FINE = 1 << 24


class Tree(NamedTuple):
    feature: np.ndarray  # of each inner node, in heap order
    cut: np.ndarray
    leaf: np.ndarray


class Model(NamedTuple):
    start: float
    trees: list[Tree]
    steps_x: np.ndarray  # isotonic calibration of the raw score
    steps_y: np.ndarray


def _reached(tree: Tree, columns: np.ndarray, level: int) -> np.ndarray:
    """Which node of the level each row comes to, counted from the level's first; columns[f] holds feature f of all rows."""
    at = np.zeros(columns.shape[1], np.uint8)
    for depth in range(level):
        above = np.zeros(len(at), bool)
        for i in range(1 << depth):
            node = (1 << depth) - 1 + i
            above |= (at == i) & (columns[tree.feature[node]] > tree.cut[node].item())
        at = 2 * at + above
    return at


def _leaf_of(tree: Tree, columns: np.ndarray) -> np.ndarray:
    return tree.leaf[_reached(tree, columns, len(tree.leaf).bit_length() - 1)]


def _total(start: float, trees: list[Tree], columns: np.ndarray) -> np.ndarray:
    return start + sum((_leaf_of(t, columns) for t in trees), np.zeros(columns.shape[1]))


def raw(model: Model, x: np.ndarray) -> np.ndarray:
    return _total(model.start, model.trees, np.ascontiguousarray(x.T)) if len(x) else np.zeros(0)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities."""
    return calibrated(model, raw(model, x))


def calibrated(model: Model, score: np.ndarray) -> np.ndarray:
    return np.interp(score, model.steps_x, model.steps_y) if len(score) else np.zeros(0)


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing fit of good / n to the distinct scores (pool adjacent violators), as points."""
    blocks: list[list[float]] = []  # good, all, last score
    for s, k, w in sorted(zip(score.tolist(), good.tolist(), n.tolist(), strict=True)):
        blocks.append([k, w, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            k, w, s = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k, blocks[-1][1] + w, s]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def binned(columns: np.ndarray, grid: list[np.ndarray]) -> np.ndarray:
    """Bin k of a feature lies above k of its cuts."""
    return np.array([np.searchsorted(cuts, own) for cuts, own in zip(grid, columns, strict=True)], np.uint8)


def sums(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, start: float, trees: list[Tree], tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of rows: first and second derivatives after `trees`, by (node of the tree's level, feature, bin); rows by node. Sums of blocks are added."""
    p = 1 / (1 + np.exp(-_total(start, trees, bins)))
    g, h = np.rint((p - y) * FINE) * weight, np.rint(p * (1 - p) * FINE) * weight
    at, nodes = _reached(tree, bins, level).astype(np.intp), 1 << level
    first, out = at * BINS, np.zeros((2, nodes, len(bins), BINS))
    for f, own in enumerate(bins):
        cell = first + own
        for of, values in zip(out, (g, h), strict=True):
            of[:, f] = np.bincount(cell, values, nodes * BINS).reshape(nodes, BINS)
    return out, np.bincount(at, minlength=nodes)


def grow(measure: Callable[[list[Tree], Tree, int], tuple[np.ndarray, np.ndarray]], cuts: np.ndarray, trees: int = 40, depth: int = 3, shrink: float = 0.3) -> list[Tree]:
    """Trees of fixed depth over bins, by Newton gain; `measure` gives the `sums` of all rows, `cuts` are those of each feature, by number. A node without gain sends all rows left."""
    made: list[Tree] = []
    within = np.arange(BINS - 1) < cuts[:, None]
    for _ in range(trees):
        tree = Tree(np.zeros(2**depth - 1, int), np.full(2**depth - 1, BINS), np.zeros(2**depth))
        for level in range(depth):
            found, n = measure(made, tree, level)
            for i in range(1 << level):
                g, h = found[:, i] / FINE
                total_g, total_h = g[0].sum(), h[0].sum()
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gain = np.where(within, gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1), 0)
                f, k = np.unravel_index(gain.argmax(), gain.shape)
                left = (total_g, total_h)
                if n[i] > 8 and gain[f, k] > 1e-6:
                    node = (1 << level) - 1 + i
                    tree.feature[node], tree.cut[node], left = f, k, (gl[f, k], hl[f, k])
                if level == depth - 1:
                    for j, (a, b) in enumerate((left, (total_g - left[0], total_h - left[1]))):
                        tree.leaf[2 * i + j] = np.rint(-shrink * a / (b + 1) * UNIT) / UNIT
        made.append(tree)
    return made


def start_of(good: float, n: float) -> float:
    rate = np.clip(good / n, 1e-3, 1 - 1e-3)
    return float(np.rint(np.log(rate / (1 - rate)) * UNIT) / UNIT)


def unbinned(trees: list[Tree], grid: list[np.ndarray]) -> list[Tree]:
    """The trees with cuts of values in place of bins."""
    return [t._replace(cut=np.array([grid[f][k] if k < BINS else np.inf for f, k in zip(t.feature, t.cut, strict=True)], float)) for t in trees]


def calibrate(model: Model, score: np.ndarray, good: np.ndarray, n: np.ndarray) -> Model:
    """The model, calibrated by distinct scores of held rows."""
    points = isotonic(score, good, n) if len(score) else (np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
    return model._replace(steps_x=points[0], steps_y=points[1])


def cuts_of(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cuts between distinct values in order: each if they are few, else those that reach another sixteenth of all n."""
    upto = n.cumsum()
    steps = upto * BINS // upto[-1] > (upto - n) * BINS // upto[-1]
    return values[:-1] if len(values) <= BINS else values[:-1][steps[:-1]]


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, shrink: float = 0.3) -> Model:
    """Trees from the rows that aren't held, calibration from the held ones; all rows lie in memory."""
    weight = np.ones(len(x), np.int64) if weight is None else weight
    own, target, w = np.ascontiguousarray(x[~held].T), y[~held].astype(float), weight[~held]
    grid = [cuts_of(u, np.bincount(at, w).astype(np.int64)) for u, at in (np.unique(column, return_inverse=True) for column in own)]
    bins, start = binned(own, grid), start_of((target * w).sum(), w.sum())
    made = grow(lambda *at: sums(bins, target, w, start, *at), np.array([len(c) for c in grid]), trees, depth, shrink)
    model = Model(start, unbinned(made, grid), np.zeros(0), np.zeros(0))
    score, at = np.unique(raw(model, x[held]), return_inverse=True)
    return calibrate(model, score, np.bincount(at, weight[held] * y[held], len(score)), np.bincount(at, weight[held], len(score)))
