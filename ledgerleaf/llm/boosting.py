"""Gradient-boosted trees over a table of cells: binned features, weights, a label.

Trees see bins only, so rows that fall into one cell are one example with a weight: the
table that the rows are counted into is all that training needs, and its size is bounded by
the number of cells, not by the rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

Cell = tuple[tuple[int, ...], float, float]  # bins, rows, rows with the label


def _tree(cells: list, gradient: list[float], hessian: list[float], at: list[int], depth: int, l2: float):
    """Splits of the most gain; the sums of each bin are built once for each feature."""
    g, h = sum(gradient[i] for i in at), sum(hessian[i] for i in at)
    best = (1e-6, None)
    for f in range(len(cells[0][0])) if depth else ():
        bins: dict[int, list[float]] = {}
        for i in at:
            one = bins.setdefault(cells[i][0][f], [0.0, 0.0])
            one[0] += gradient[i]
            one[1] += hessian[i]
        gl = hl = 0.0
        order = sorted(bins)
        for low, cut in pairwise(order):
            gl, hl = gl + bins[low][0], hl + bins[low][1]
            gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
            if gain > best[0] + 1e-12:
                best = (gain, (f, cut))
    if best[1] is None:
        return -g / (h + l2)
    f, cut = best[1]
    left, right = [i for i in at if cells[i][0][f] < cut], [i for i in at if cells[i][0][f] >= cut]
    return (f, cut, _tree(cells, gradient, hessian, left, depth - 1, l2), _tree(cells, gradient, hessian, right, depth - 1, l2))


def value(tree, bins) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if bins[tree[0]] < tree[1] else tree[3]
    return tree


def boost(cells: list[Cell], rounds: int = 12, depth: int = 3, rate: float = 0.4, l2: float = 1.0) -> tuple[float, list]:
    """(start, trees) of additive log-odds."""
    n, yes = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((yes + 0.5) / (n - yes + 0.5))
    total, trees = [start] * len(cells), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-t)) for t in total]
        gradient = [c[1] * q - c[2] for c, q in zip(cells, p, strict=True)]
        hessian = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        tree = _tree(cells, gradient, hessian, list(range(len(cells))), depth, l2)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        total = [t + rate * value(tree, c[0]) for t, c in zip(total, cells, strict=True)]
    return start, [_scaled(t, rate) for t in trees]


def _scaled(tree, rate):
    return (*tree[:2], _scaled(tree[2], rate), _scaled(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def log_odds(model: tuple[float, list], bins) -> float:
    return model[0] + sum(value(t, bins) for t in model[1])


def expression(model: tuple[float, list], bins: list[Column]) -> Column:
    """The model's log-odds as a column of the binned features."""

    def of(tree) -> Column:
        return F.when(bins[tree[0]] < tree[1], of(tree[2])).otherwise(of(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    return reduce(lambda a, t: a + of(t), model[1], F.lit(float(model[0])))


def threshold(model: tuple[float, list], cells: list[Cell], precision: float) -> float:
    """The least log-odds above which the labelled share is at least ``precision``; infinite if none is."""
    best, n, yes = math.inf, 0.0, 0.0
    levels: dict[float, list[float]] = {}
    for bins, rows, hits in cells:
        at = levels.setdefault(round(log_odds(model, bins), 9), [0.0, 0.0])
        at[0] += rows
        at[1] += hits
    for level in sorted(levels, reverse=True):
        n, yes = n + levels[level][0], yes + levels[level][1]
        if yes / n >= precision:
            best = level
    return best - 1e-6
