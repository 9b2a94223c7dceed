"""A small gradient-boosting fitter (log loss, shallow trees) and its trees as DataFrame expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float, least: int):
    """A tree as nested (feature, threshold, left, right) or a leaf value; the left side holds x <= threshold."""
    total, weight = gradient.sum(), hessian.sum()
    leaf = float(-total / (weight + ridge))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, where = total**2 / (weight + ridge) + 1e-6, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], gradient[order].cumsum()[:-1], hessian[order].cumsum()[:-1]
        cut = (v[1:] > v[:-1]) & (np.arange(1, len(v)) >= least) & (np.arange(1, len(v)) <= len(v) - least)
        if cut.any():
            gain = np.where(cut, g**2 / (h + ridge) + (total - g) ** 2 / (weight - h + ridge), -np.inf)
            i = int(gain.argmax())
            if gain[i] > best:
                best, where = gain[i], (j, float((v[i] + v[i + 1]) / 2))
    if where is None:
        return leaf
    left = x[:, where[0]] <= where[1]
    return (*where, grow(x[left], gradient[left], hessian[left], depth - 1, ridge, least), grow(x[~left], gradient[~left], hessian[~left], depth - 1, ridge, least))


def value(tree, x: np.ndarray) -> np.ndarray:
    """The tree's values of the rows of x."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    return np.where(x[:, j] <= cut, value(left, x), value(right, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 4):
    """(bias, trees): the log odds are bias + rate times the sum of the trees, the rate being folded into leaves."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, out = np.full(len(y), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        t = shrink(grow(x, q - y, q * (1 - q), depth, ridge, least), rate)
        out.append(t)
        f = f + value(t, x)
    return base, out


def shrink(tree, rate: float):
    """The tree with its leaves times rate."""
    return tree * rate if not isinstance(tree, tuple) else (tree[0], tree[1], shrink(tree[2], rate), shrink(tree[3], rate))


def column(tree, features: list[Column]) -> Column:
    """The tree as nested conditions over feature columns."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, cut, left, right = tree
    return F.when(features[j] <= F.lit(cut), column(left, features)).otherwise(column(right, features))
