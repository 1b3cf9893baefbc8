"""Boosted trees by histograms against every possible split, and exact attributions against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import boosting as b
from signalspark.operators import models as mod
from signalspark.operators import tree_shap
from signalspark.operators.fold_table import fold_table, united
from signalspark.params import FoldParams
from test_metrics_and_models import training_rows

PARAMS = FoldParams(40, 10, 3)
FEW = b.BoostParams(trees=12, depth=3, rate=0.3)


def drawn(n=300, width=4, seed=1):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 12, (n, width)).astype(np.uint8)
    y = (rng.random(n) < 1 / (1 + np.exp(-(bins[:, 0] / 3.0 - 2 + (bins[:, 1] > 6) * (bins[:, 2] < 4) * 3)))).astype(float)
    return bins, y


def gain(g, h, p):
    return sum(g) ** 2 / (sum(h) + p.penalty)


def test_splits_are_the_best_of_all():
    bins, y = drawn()
    p = b.BoostParams()
    g, h = b.slopes(y, np.linspace(-1, 1, len(y)))
    node = np.arange(len(y)) % 3
    found = b.best_splits(b.histograms(bins, g, h, node, 3), p)
    for k in range(3):
        mine = node == k
        best = (0, -1, -1)
        for f, cut in itertools.product(range(4), range(12)):
            left = mine & (bins[:, f] <= cut)
            right = mine & ~left
            if h[left].sum() >= 1 and h[right].sum() >= 1:
                value = (gain(g[left], h[left], p) + gain(g[right], h[right], p) - gain(g[mine], h[mine], p)) / 2
                if value > best[0] + 1e-9:
                    best = (value, f, cut)
        assert (found["feature"][k], found["cut"][k]) == best[1:] and found["gain"][k] == pytest.approx(best[0])


def test_a_tree_follows_its_splits():
    bins, y = drawn()
    trees = b.grow(bins, y, FEW)
    again = b.Trees.unpack(trees.pack())
    assert np.array_equal(trees.margin(bins), again.margin(bins))
    margin = np.zeros(len(y))
    for t in range(len(trees)):
        g, h = b.slopes(y, margin)
        for r in range(0, len(y), 17):
            at = 0
            while trees.feature[t, at] >= 0:
                at = 2 * at + 1 + int(bins[r, trees.feature[t, at]] > trees.cut[t, at])
            same = trees.node_of(t, bins, FEW.depth) == at
            assert same[r] and trees.value[t, at] == pytest.approx(-FEW.rate * g[same].sum() / (h[same].sum() + FEW.penalty))
            assert trees.cover[t, at] == pytest.approx(h[same].sum())
        margin += trees.margin(bins, t, t + 1)
    assert np.mean(np.logaddexp(0, margin) - y * margin) < 0.55 < np.log(2)
    # rows that nothing tells apart are one leaf
    alone = b.grow(np.zeros((5, 2), np.uint8), np.array([1, 1, 1, 1, 0.0]), FEW)
    assert (alone.feature < 0).all() and alone.margin(np.zeros((1, 2), np.uint8))[0] > 0


def test_passes_and_tasks_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(b, "PENDING", 5)
    df = training_rows(spark).withColumn("g", F.when(F.col("a") > 0, "up").otherwise("all")).withColumn("c", F.lit(1.0))
    table = fold_table(df, ["a", "b", "c"], PARAMS, ["g"])
    rows = b.binned(table)
    whole = {r.model: r for r in b.fit_boosted(table, FEW, rows=rows).collect()}
    passes = {r.model: r for r in b.fit_boosted(table, FEW, task_cells=0, rows=rows.repartition(3)).collect()}
    some = {r.model: r for r in b.fit_boosted(table, FEW, task_cells=300, rows=rows).collect()}
    assert whole.keys() == passes.keys() == some.keys() and len(whole) == 6
    for name, r in whole.items():
        for other in (passes[name], some[name]):
            a, z = b.Trees.unpack(r.trees), b.Trees.unpack(other.trees)
            assert np.array_equal(a.feature, z.feature) and np.array_equal(a.cut, z.cut) and r.n_train == other.n_train
            assert np.allclose(a.value, z.value) and np.allclose(a.cover, z.cover)


def test_boosted_predictions(spark, monkeypatch):
    df = training_rows(spark)
    table = fold_table(df, ["a", "b"], PARAMS)
    out = mod.cv_boosted(df, ["a", "b"], PARAMS).collect()
    assert len(out) == 120 and all((r.proba > 0.5) == (r.y_pred == 1) for r in out)
    assert np.mean([r.y_pred == r.y_true for r in out]) > 0.6
    assert {r.model_type for r in out} == {"boosted_trees"}
    # trees that go out in turns, and two tables of different width in one run
    wide = fold_table(df.withColumn("c", F.col("a") * F.col("b")), ["a", "b", "c"], PARAMS, variant="wide")
    both = united([table, wide])
    rows = b.binned(both)
    fitted = b.fit_boosted(both, FEW, rows=rows)
    once = sorted(b.predict_boosted(both, fitted, rows).select("model", "Ticker", "Date", "margin").collect())
    monkeypatch.setattr(b, "BROADCAST_BYTES", 1)
    assert len(list(b.trees_in_turns(fitted, 1))) == 6
    turns = b.scored_rows(both, fitted, rows, lambda t, x: {"margin": b.pa.array(t.margin(x))}, "margin double")
    assert sorted(turns.select("model", "Ticker", "Date", "margin").collect()) == once and len(once) == 240
    shares = b.boosted_importance(fitted.filter("model like 'baseline%'"), ["a", "b"]).groupBy("model").agg(F.sum("importance").alias("s"))
    assert [round(r.s, 9) for r in shares.collect()] == [1.0] * 3


def expectation(trees, t, x, known, at=0):
    """Mean of a tree's value when only the features ``known`` of row ``x`` are known."""
    f = trees.feature[t, at]
    if f < 0:
        return trees.value[t, at]
    if f in known:
        return expectation(trees, t, x, known, 2 * at + 1 + int(x[f] > trees.cut[t, at]))
    sides = [trees.cover[t, 2 * at + 1 + s] / trees.cover[t, at] * expectation(trees, t, x, known, 2 * at + 1 + s) for s in (0, 1)]
    return sum(sides)


def test_attributions_equal_all_subsets():
    bins, y = drawn(width=6, seed=5)
    trees = b.grow(bins, y, b.BoostParams(trees=6, depth=5, least_curvature=0.1))
    some = bins[:7]
    phi, base = tree_shap.contributions(trees, some)
    assert np.allclose(phi.sum(axis=1) + base, trees.margin(some))
    for x, got in zip(some, phi):
        for i in range(6):
            others, want = [f for f in range(6) if f != i], 0.0
            for size in range(6):
                weight = math.factorial(size) * math.factorial(5 - size) / math.factorial(6)
                for known in itertools.combinations(others, size):
                    want += weight * sum(expectation(trees, t, x, {*known, i}) - expectation(trees, t, x, set(known)) for t in range(6))
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_attribution_table(spark):
    df = training_rows(spark)
    table = fold_table(df, ["a", "b"], PARAMS)
    rows = b.binned(table)
    fitted = b.fit_boosted(table, FEW, rows=rows)
    parts = tree_shap.tree_contributions(table, fitted, rows)
    for r in parts.collect():
        assert sum(r.phi) + r.base == pytest.approx(r.margin)
    got = {(r.model, r.feature): r.importance for r in tree_shap.tree_attribution(parts, ["a", "b"]).collect()}
    held = parts.collect()
    for (model, feature), value in got.items():
        mine = [abs(r.phi["ab".index(feature)]) for r in held if r.model == model]
        assert value == pytest.approx(np.mean(mine)) and len(mine) == 40
