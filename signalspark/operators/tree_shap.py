"""Exact Shapley values of boosted trees, from the arrays of their nodes.

A leaf counts for a set of known features by the share of cover that reaches it where
features are unknown, and by whether the row takes its way where they are known. For one
leaf the Shapley sum over all sets of the features on its path is a polynomial
in the number of known ones, built a feature at a time. A row's answers on a path are a
pattern of at most ``2 ** depth``, so contributions are worked out once per leaf and
pattern and looked up for every row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators.boosting import Trees, scored_rows
from signalspark.operators.fold_table import FoldTable

Path = list[tuple[int, int]]  # (node, side) from the root down


def paths(trees: Trees, tree: int) -> list[tuple[int, Path]]:
    """(leaf, path) of every leaf of a tree."""
    found, todo = [], [(0, [])]
    while todo:
        at, path = todo.pop()
        if trees.feature[tree, at] < 0:
            found.append((at, path))
        else:
            todo += [(2 * at + 1 + side, [*path, (at, side)]) for side in (0, 1)]
    return found


@lru_cache
def _patterns(width: int) -> np.ndarray:
    """(2 ** width, width) zeros and ones; bit j of the row number is column j."""
    return (np.arange(2**width)[:, None] >> np.arange(width) & 1).astype(float)


def leaf_table(value: float, zero: np.ndarray) -> np.ndarray:
    """(patterns, features) contributions of a leaf whose features keep the shares ``zero`` of the cover.

    The product over the other features of (zero + t * one) holds, at t**k, all sets of k
    known ones; each such set has the weight k! (m - 1 - k)! / m!.
    """
    m = len(zero)
    one = _patterns(m)
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty_like(one)
    for i in range(m):
        poly = np.zeros((len(one), m))
        poly[:, 0] = 1
        for j in range(m):
            if j != i:
                poly[:, 1:], poly[:, 0] = poly[:, 1:] * zero[j] + poly[:, :-1] * one[:, j, None], poly[:, 0] * zero[j]
        out[:, i] = value * (one[:, i] - zero[i]) * (poly @ weight)
    return out


def contributions(trees: Trees, bins: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows, features) Shapley values and the mean margin that they are added to."""
    phi = np.zeros(bins.shape)
    base = 0.0
    for tree in range(len(trees)):
        right = bins[:, np.maximum(trees.feature[tree], 0)] > trees.cut[tree]  # by node
        for leaf, path in paths(trees, tree):
            features = sorted({int(trees.feature[tree, at]) for at, _ in path})
            zero, pattern = np.ones(len(features)), np.zeros(len(bins), np.int64)
            for j, f in enumerate(features):
                mine = [(at, side) for at, side in path if trees.feature[tree, at] == f]
                zero[j] = np.prod([trees.cover[tree, 2 * at + 1 + side] / trees.cover[tree, at] for at, side in mine])
                took = np.logical_and.reduce([right[:, at] == bool(side) for at, side in mine])
                pattern |= took.astype(np.int64) << j
            value = float(trees.value[tree, leaf])
            base += value * float(np.prod(zero))
            if features:
                phi[:, features] += leaf_table(value, zero)[pattern]
    return phi, base


def tree_contributions(table: FoldTable, fitted: DataFrame, rows: DataFrame) -> DataFrame:
    """Test rows with ``phi`` (a value per feature), ``base`` and ``margin`` of their fold's trees."""
    def score(trees: Trees, bins: np.ndarray) -> dict[str, pa.Array]:
        phi, base = contributions(trees, bins)
        return {"phi": pa.array(list(phi), pa.list_(pa.float64())), "base": pa.array(np.full(len(bins), base)),
                "margin": pa.array(trees.margin(bins))}

    return scored_rows(table, fitted, rows, score, "phi array<double>, base double, margin double")


def tree_attribution(parts: DataFrame, features: Sequence[str]) -> DataFrame:
    """(model, feature, importance): mean absolute contribution of ``tree_contributions``."""
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_pos") + 1)
    each = parts.select("model", F.posexplode("phi").alias("_pos", "_phi"))
    return (each.groupBy("model", "_pos").agg(F.avg(F.abs("_phi")).alias("importance"))
            .select("model", name.alias("feature"), "importance"))
