import itertools
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalspark.operators import attribution, metrics
from signalspark.operators import models as mod
from signalspark.operators.fold_table import fold_table
from signalspark.operators.logistic import assemble, fit_fold_logistic, fit_logistic, predict_logistic
from signalspark.operators.ordered import auc, exact_quantiles
from signalspark.params import FoldParams
from signalspark.plans import report

D0 = date(2024, 1, 1)


def predictions(spark, rows):
    """(variant, fold, ticker, day, y_true, y_pred, proba, return)"""
    return spark.createDataFrame(
        [(v, f, t, D0 + timedelta(d), y, p, q, r) for v, f, t, d, y, p, q, r in rows],
        "variant string, fold int, Ticker string, Date date, y_true int, y_pred int, proba double, fwd_return double")


def test_metrics_of_five_rows(spark):
    rows = [("v", 0, "A", i, y, p, q, 0.0) for i, (y, p, q) in enumerate(
        zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1], [.2, .8, .4, .3, .9]))]
    rows += [("one_class", 0, "A", i, 1, 1, 0.5, 0.0) for i in range(3)]
    got = {r.variant: r for r in metrics.classification_metrics(predictions(spark, rows), ["variant"]).collect()}
    m = got["v"]
    assert (m.accuracy, m.precision, m.auc) == (0.8, 1.0, 1.0)
    assert m.recall == pytest.approx(2 / 3) and m.f1 == pytest.approx(0.8)
    assert (m.true_positive, m.true_negative, m.false_positive, m.false_negative) == (2, 2, 0, 1)
    one = got["one_class"]
    assert (one.accuracy, one.f1, one.auc, one.precision, one.true_positive) == (1.0, 1.0, 0.5, None, None)
    over = metrics.over_folds(metrics.classification_metrics(predictions(spark, rows), ["variant", "fold"]),
                              ["variant"], metrics.CLASSIFICATION).collect()
    assert {r.variant: r.precision_mean for r in over} == {"v": 1.0, "one_class": None}


def test_trading_of_five_rows(spark):
    rows = [("v", 0, "A", i, 1, p, 0.5, r) for i, (p, r) in enumerate(
        zip([1, 1, 0, 1, 0], [.01, .02, -.01, .015, -.005]))]
    net = metrics.strategy_returns(predictions(spark, rows), ["variant", "fold"]).orderBy("Date").collect()
    want = [.009, .02, .008, .013, .003]
    assert [r.net_return for r in net] == pytest.approx(want)
    m = metrics.fold_trading_metrics(predictions(spark, rows), ["variant", "fold"]).first()
    assert m.total_return == pytest.approx(np.prod(1 + np.array(want)) - 1)
    assert m.sharpe_ratio == pytest.approx(np.sqrt(252) * (np.mean(want) - .02 / 252) / np.std(want))
    assert (m.max_drawdown, m.win_rate) == (0.0, 1.0)
    constant = predictions(spark, [("v", 0, "A", i, 1, 1, .5, r) for i, r in enumerate([.012, .011, .011])])
    assert metrics.fold_trading_metrics(constant, ["variant"]).first().sharpe_ratio == 0.0


def test_drawdown_follows_the_running_peak(spark):
    r = [.1, -.2, .05, .3, -.1]
    df = spark.createDataFrame([("s", D0 + timedelta(i), x) for i, x in enumerate(r)],
                               "k string, Date date, net_return double")
    out = metrics.drawdown(metrics.equity_curve(df, ["k"]), ["k"]).orderBy("Date").collect()
    cum = np.cumprod(1 + np.array(r)) - 1
    peak = np.maximum.accumulate(cum)
    assert [x.drawdown for x in out] == pytest.approx(list((cum - peak) / (1 + peak)))


@pytest.mark.parametrize("limits", [{}, {"max_group_rows": 0, "ranges": 8}])
def test_quantiles_and_auc_equal_brute_force(spark, limits):
    rng = random.Random(2)
    # group "hot" holds most rows and a third of them are one value
    rows = [("hot", rng.choice([0.5, rng.random(), round(rng.random(), 1)]), rng.randrange(2)) for _ in range(900)]
    rows += [("small", rng.random(), i % 2) for i in range(7)] + [("one", 0.3, 1)]
    df = spark.createDataFrame(rows, "g string, proba double, y_true int").repartition(4)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "proba", probs, **limits).collect()}
    areas = {r.g: r.auc for r in auc(df, ["g"], **limits).collect()}
    for g in ("hot", "small", "one"):
        values = [v for k, v, _ in rows if k == g]
        assert [got[g][n] for n in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))
        pos = [v for k, v, y in rows if k == g and y]
        neg = [v for k, v, y in rows if k == g and not y]
        pairs = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)]
        assert areas[g] == pytest.approx(np.mean(pairs) if pairs else 0.5)


def training_rows(spark, n_days=80, tickers="ABCD", seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_days):
        for t in tickers:
            a, b = rng.normal(), rng.normal() * 3 + 1
            y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * a - 0.4 * b))))
            rows.append((t, D0 + timedelta(i), y, float(rng.normal() / 100), float(a), float(b)))
    return spark.createDataFrame(rows, "Ticker string, Date date, Target int, fwd_return double, a double, b double")


PARAMS = FoldParams(40, 10, 3)


def test_joint_fit_equals_one_mllib_fit_per_fold(spark):
    rows = mod.fold_rows(training_rows(spark), ["a", "b"], PARAMS)
    fitted = {r.model: r for r in fit_logistic(rows.filter("role = 'train'")).collect()}
    assert sorted(fitted) == ["baseline|0", "baseline|1", "baseline|2"]
    single = mod.fit_per_fold(rows, mod.logistic_regression)
    for name, m in single.items():
        assert fitted[name].n_train == 160
        assert fitted[name].coef == pytest.approx(list(m.coefficients), abs=1e-4)
        assert fitted[name].intercept == pytest.approx(m.intercept, abs=1e-4)


def test_joint_fit_converges_on_separable_rows_and_mixed_sizes(spark):
    rows = [("sep", [float(i)], float(i > 0)) for i in (-3, -2, -1, 1, 2, 3)]
    rows += [("two", [float(i), 1.0], float(i % 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "model string, x array<double>, y double").repartition(3)
    fitted = {r.model: r for r in fit_logistic(df).collect()}
    assert len(fitted["two"].coef) == 2
    w, x, y = fitted["sep"].coef[0], np.array([-3, -2, -1, 1, 2, 3.0]), np.array([0, 0, 0, 1, 1, 1.0])
    p = 1 / (1 + np.exp(-(w * x + fitted["sep"].intercept)))
    assert w + np.sum((p - y) * x) == pytest.approx(0, abs=1e-6)


def test_unfinished_fits_say_so_and_ids_never_meet(spark):
    rows = [("m", [float(v)], float(v > 0.2)) for v in np.linspace(-1, 1, 40)]
    df = spark.createDataFrame(rows, "model string, x array<double>, y double")
    done, cut = fit_logistic(df).first(), fit_logistic(df, max_iter=1).first()
    assert done.converged and done.iterations > 2 and not cut.converged and cut.iterations == 1
    keys = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("\\N", "c"), ("a\\", "c")]
    frame = spark.createDataFrame([(*k, 1.0, 1) for k in keys], "p string, q string, f double, Target int")
    assert assemble(frame, ["f"], ["p", "q"]).select("model").distinct().count() == len(keys)


def test_sums_in_two_levels_give_the_same_fit(spark):
    rng = np.random.default_rng(1)
    rows = [("m", [float(v)], float(rng.random() < 1 / (1 + np.exp(-v)))) for v in rng.normal(size=200)]
    df = spark.createDataFrame(rows, "model string, x array<double>, y double").repartition(6)
    one, two = fit_logistic(df).first(), fit_logistic(df, fan_in=2).first()
    assert two.coef == pytest.approx(one.coef) and two.n_train == one.n_train == 200


def test_folds_inside_the_mapper_give_the_same_fit(spark):
    df = training_rows(spark).withColumn("g", F.when(F.col("a") > 0, "up").otherwise("all"))
    table = fold_table(df, ["a", "b"], FoldParams(40, 10, 6), ["g"])
    single = {r.model: r for r in fit_logistic(table.of("train")).collect()}
    joint = {r.model: r for r in fit_fold_logistic(table.rows.repartition(5), table.scales, fan_in=2).collect()}
    assert joint.keys() == single.keys() and len(joint) == 12
    for name, r in joint.items():
        assert r.coef == pytest.approx(single[name].coef, abs=1e-7) and r.n_train == single[name].n_train and r.converged


def test_predictions_and_comparison(spark):
    out = mod.cv_logistic(training_rows(spark), ["a", "b"], PARAMS).cache()
    assert out.count() == 3 * 10 * 4
    assert all((r.proba > 0.5) == (r.y_pred == 1) for r in out.collect())
    table = report.variant_names(metrics.compare(out)).first()
    assert table.Model == "Baseline" and table.model_type == "logistic_regression"
    assert table.accuracy_mean > 0.6 and table.auc_mean > 0.7
    rows = mod.fold_rows(training_rows(spark), ["a", "b"], PARAMS)
    trees = mod.fit_per_fold(rows, lambda n: mod.boosted_trees(n, maxIter=3))
    assert mod.predict_per_fold(rows, trees).count() == 120
    shares = mod.tree_importance(spark, trees, ["a", "b"]).groupBy("model").agg(F.sum("importance").alias("s"))
    assert [round(r.s, 9) for r in shares.collect()] == [1.0] * 3


def test_attribution(spark):
    rows = mod.fold_rows(training_rows(spark), ["a", "b"], PARAMS).filter("fold = 0")
    model = mod.fit_per_fold(rows, mod.logistic_regression)["baseline|0"]
    train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
    picked = attribution.sample_rows(test, 20, ["Ticker", "Date"])
    assert picked.count() == 20 and picked.collect() == attribution.sample_rows(test, 20, ["Ticker", "Date"]).collect()
    got = {r.feature: r.importance for r in attribution.sampled_shapley(
        model, picked, train, ["a", "b"], permutations=200).collect()}
    xs = np.array([r.x for r in picked.collect()])
    # a linear model's Shapley value is coefficient times distance from the background mean
    want = np.mean(np.abs(xs * np.array(list(model.coefficients))), axis=0)
    assert [got["a"], got["b"]] == pytest.approx(list(want), rel=0.15)
    fitted = fit_logistic(train)
    exact = {r.feature: r.importance for r in attribution.fitted_attribution(picked, fitted, ["a", "b"]).collect()}
    assert [exact["a"], exact["b"]] == pytest.approx(list(want), rel=1e-3)
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, importance double")
    right = spark.createDataFrame([("b", 3.0), ("c", 1.5)], "feature string, importance double")
    both = [tuple(r) for r in attribution.compare_importance(left, right).collect()]
    assert both == [("b", 2.0, 3.0, 1.0), ("c", 0.0, 1.5, 1.5), ("a", 1.0, 0.0, -1.0)]
    assert [r.feature for r in attribution.top_features(left, 1).collect()] == ["b"]


def test_histogram_and_boxplot(spark):
    values = [0.0, 0.1, 0.2, 0.3, 1.0, 10.0]
    df = spark.createDataFrame([("A", v) for v in values], "Ticker string, sentiment_score double")
    bins = {r.bin: r.n for r in report.score_histogram(df, bins=5).collect()}
    assert bins == {1: 5, 5: 1}
    for limits in ({}, {"max_group_rows": 0, "ranges": 4}):
        box = report.score_boxplot(df, **limits).first()
        assert (box.median, box.whisker_high, box.outliers) == (pytest.approx(0.25), 1.0, 1)
    assert report.score_histogram(df.limit(1)).first().n == 1
    assert report.score_histogram(df.limit(0)).count() == 0


def test_samples_of_all_groups_at_once(spark):
    rows = [(g, k, float(k)) for g, n in (("a", 500), ("b", 3), (None, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5)
    got = attribution.sample_per_group(df, ["g"], 10, ["k"])
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    for g, n in (("a", 10), ("b", 3), (None, 10)):
        one = attribution.sample_rows(df.filter(F.col("g").eqNullSafe(g)), 10, ["k"]).collect()
        assert sorted(r.k for r in got.filter(F.col("g").eqNullSafe(g)).collect()) == sorted(r.k for r in one) and len(one) == n


def test_importance_of_a_constant_feature(spark):
    from workload.spark_queries import _correlations

    rows = [(0.1, 1.0, 1, None), (0.1, 2.0, 0, 5.0), (0.1, 4.0, 1, None), (0.1, 4.0, 1, None)]
    df = spark.createDataFrame(rows, "flat double, a double, Target int, once double").repartition(3)
    right = _correlations(df, ["flat", "a", "once"])
    got = {r.feature: r.importance for r in right.collect()}
    assert math.isnan(got["flat"]) and math.isnan(got["once"])
    assert got["a"] == pytest.approx(abs(np.corrcoef([1, 2, 4, 4], [1, 0, 1, 1])[0, 1]))
    assert _correlations(df.limit(0), ["a"]).first().importance is None
    both = {r.feature: r for r in attribution.compare_importance(right.filter("feature = 'a'"), right).collect()}
    # as coalesce in SQL: only what is missing counts as 0
    assert both["flat"].baseline_importance == 0 and math.isnan(both["flat"].sentiment_importance)
    assert math.isnan(both["flat"].importance_change) and both["a"].importance_change == 0


def test_top_features_with_a_constant_one(spark):
    from workload.spark_queries import _correlations

    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1), (1.0, 2.0, 3.0, 0), (1.0, 4.0, 1.0, 1)], "flat double, a double, b double, Target int")
    top = attribution.top_features(_correlations(df, ["flat", "a", "b"]), 2).collect()
    # as ORDER BY importance DESC in SQL: NaN is the largest
    assert [r.feature for r in top] == ["flat", "b"] and math.isnan(top[0].importance)
    assert top[1].importance == pytest.approx(1.0)


def test_tasks_of_a_fit_follow_its_rows(spark, monkeypatch):
    class Tasks:
        def fit(self, df):
            return df.rdd.getNumPartitions(), df.count()

    rows = spark.createDataFrame([(f"m{k % 2}", "train", k % 3, [float(k)]) for k in range(600)], "model string, role string, y int, x array<double>")
    rows = rows.repartition(12)  # as many files
    assert mod.fit_per_fold(rows, lambda n: Tasks()) == {"m0": (1, 300), "m1": (1, 300)}
    monkeypatch.setattr(mod, "FIT_ROWS", 100)
    assert [mod.fit_tasks(n) for n in (0, 1, 100, 101, 1000)] == [1, 1, 1, 2, 10]
    assert mod.fit_per_fold(rows, lambda n: Tasks()) == {"m0": (3, 300), "m1": (3, 300)}
