import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from signalspark.operators import features as feat
from signalspark.operators import indicators as ind
from signalspark.operators.folds import assign_folds, fold_days, standardize
from signalspark.params import FoldParams

D0 = date(2024, 1, 1)


def closes(spark, values, ticker="AAPL"):
    return spark.createDataFrame([(ticker, D0 + timedelta(i), float(v)) for i, v in enumerate(values)],
                                 "Ticker string, Date date, Close double")


def column(df, name):
    return [r[name] for r in df.orderBy("Date").collect()]


def test_returns_of_five_closes(spark):
    out = ind.add_returns(closes(spark, [100, 101, 99, 102, 105]), [1])
    assert column(out, "return_1d")[0] is None
    assert column(out, "return_1d")[1:] == pytest.approx([0.01, -2 / 101, 3 / 99, 3 / 102])
    zero = ind.add_returns(closes(spark, [0, 5, 0]), [1])
    assert column(zero, "return_1d") == [None, None, -1.0]
    assert column(zero, "log_return_1d") == [None, None, None]


def smoothed(values, alpha):
    out = [values[0]]
    for x in values[1:]:
        out.append(alpha * x + (1 - alpha) * out[-1])
    return out


def test_smoothed_indicators_equal_sequential_loops(spark):
    rng = random.Random(1)
    values = [100.0]
    for _ in range(249):
        values.append(max(1.0, values[-1] + rng.gauss(0, 2)))
    out = ind.add_all_indicators(closes(spark, values)).orderBy("Date").collect()
    fast, slow = smoothed(values, 2 / 13), smoothed(values, 2 / 27)
    line = [a - b for a, b in zip(fast, slow)]
    signal = [None] * 33 + smoothed(line[25:], 0.2)[8:]
    steps = [0.0] + [b - a for a, b in zip(values, values[1:])]
    gain, loss = (smoothed([max(s * x, 0) for x in steps], 1 / 14) for s in (1, -1))
    for i, r in enumerate(out):
        assert r.EMA_12 == pytest.approx(fast[i]) and r.EMA_26 == pytest.approx(slow[i])
        assert (r.MACD is None) == (i < 25) and (r.RSI is None) == (i < 13)
        assert (r.MACD_signal is None) == (i < 33)
        if i >= 33:
            assert r.MACD_signal == pytest.approx(signal[i], abs=1e-9)
            assert r.MACD_diff == pytest.approx(line[i] - signal[i], abs=1e-9)
        if i >= 13:
            assert r.RSI == pytest.approx(100 - 100 / (1 + gain[i] / loss[i]))
    rising = ind.add_rsi(closes(spark, range(1, 31)))
    assert column(rising, "RSI")[13:] == [100.0] * 17


def test_indicator_chain_needs_one_exchange(spark):
    df = closes(spark, range(1, 50)).repartition(3)
    plan = ind.add_all_indicators(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_target_and_lags_stay_inside_a_ticker(spark):
    both = closes(spark, [1, 2, 1]).union(closes(spark, [5, 4], "MSFT"))
    got = {(r.Ticker, r.Date): r.Target for r in feat.add_target(both).collect()}
    assert got == {("AAPL", D0): 1, ("AAPL", D0 + timedelta(1)): 0, ("MSFT", D0): 0}
    lagged = feat.add_lags(both, ["Close", "absent"], [1]).filter("Ticker = 'MSFT'")
    assert column(lagged, "Close_lag1") == [None, 5.0]


def test_fills_carry_forward_then_zero(spark):
    rows = [("A", D0, None, None, None), ("A", D0 + timedelta(1), 0.5, 0.1, 0.2),
            ("A", D0 + timedelta(2), None, None, None)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, sent_mean double, RSI double, positive_mean double")
    assert column(feat.fill_features(df), "sent_mean") == [0.0, 0.5, 0.5]
    assert column(feat.fill_features(df), "RSI") == [0.0, 0.1, 0.1]
    assert column(feat.fill_features(df), "positive_mean") == [0.0, 0.2, 0.0]
    assert column(feat.fill_features(df, strict_parity=True), "positive_mean") == [None, 0.2, None]


def test_sentiment_features_by_type(spark):
    df = closes(spark, [1, 2, 3]).withColumn("sent_mean", F.lit(0.5))
    made = feat.add_sentiment_features(df, "flat").columns
    assert {"sent_mean_lag1", "sent_momentum", "sent_volatility"} <= set(made)
    assert feat.add_sentiment_features(df, "decay").columns == df.columns
    with pytest.raises(ValueError):
        feat.add_sentiment_features(df, "other")
    names = feat.feature_names(made)
    assert "Close" not in names and feat.feature_names(made, False) == []


def test_shared_technical_table_gives_the_same_features(spark):
    market = feat.add_target(closes(spark, [10 + (i * 7) % 13 for i in range(60)]))
    daily = market.filter(F.day("Date") % 3 == 0).select("Ticker", "Date", (F.day("Date") / 31).alias("sent_mean"))
    direct = feat.prepare_features(feat.merge_sentiment(market, daily), "flat")
    shared = feat.with_sentiment(feat.technical_table(market), daily, "flat")
    rows = lambda d: sorted(map(str, d.select(*sorted(direct.columns)).collect()))
    assert rows(direct) == rows(shared)


def days(spark, n):
    return spark.range(n).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("Date"))


def brute_folds(n, p):
    step, out = max(1, (n - p.train_days - p.test_days) // max(1, p.folds - 1)), set()
    for i in range(p.folds):
        a = i * step
        if a + p.train_days + p.test_days > n:
            break
        out |= {(i, "train", d) for d in range(a, a + p.train_days)}
        out |= {(i, "test", d) for d in range(a + p.train_days, a + p.train_days + p.test_days)}
    return out


@pytest.mark.parametrize("n, p", [(500, FoldParams(252, 21, 3)), (30, FoldParams(20, 5, 10)),
                                  (25, FoldParams(20, 5, 1)), (40, FoldParams(10, 3, 4))])
def test_folds_equal_brute_force(spark, n, p):
    got = fold_days(days(spark, n), p).collect()
    assert {(r.fold, r.role, r.day_idx) for r in got} == brute_folds(n, p)
    assert len(got) == len(brute_folds(n, p))


def test_too_few_days_is_an_error(spark):
    with pytest.raises(Exception, match="Not enough data"):
        fold_days(days(spark, 10), FoldParams(20, 5, 2)).collect()


def test_scaling_uses_training_rows_only(spark):
    p = FoldParams(10, 3, 2)
    rows = days(spark, 20).withColumns({"x": F.day("Date").cast("double"), "c": F.lit(0.1)})
    out = standardize(assign_folds(rows, fold_days(rows, p)), ["x", "c"], ["fold"])
    for fold in (0, 1):
        train = [r.x for r in out.filter(f"fold = {fold} and role = 'train'").collect()]
        assert sum(train) == pytest.approx(0, abs=1e-9)
        assert sum(v * v for v in train) / len(train) == pytest.approx(1)
    assert {round(r.c, 9) for r in out.collect()} == {0.0}


@pytest.mark.parametrize("p", [FoldParams(10, 3, 2), FoldParams(10, 3, 6), FoldParams(9, 4, 1)])
def test_fold_table_holds_every_row_once(spark, p):
    from signalspark.operators.fold_table import fold_table

    # prices far from 0, a constant, and a group that has no rows on some days, even at the edges of folds
    rows = days(spark, 20).withColumns({
        "g": F.explode(F.array(F.lit("all"), F.lit("some"), F.lit(None).cast("string"))), "Ticker": F.lit("A"), "fwd_return": F.lit(0.1),
        "Target": F.day("Date") % 2, "x": F.pow(F.day("Date").cast("double"), 2) + 1e6, "c": F.lit(0.1)})
    rows = rows.filter("g is distinct from 'some' or day(Date) % 4 = 2")
    table = fold_table(rows, ["x", "c"], p, ["g"])
    assert table.rows.count() == rows.join(fold_days(rows, p).select("Date").distinct(), "Date").count()
    want = standardize(assign_folds(rows.fillna("-", "g"), fold_days(rows, p)), ["x", "c"], ["g", "fold"])
    key = lambda r: (r.g or "-", r.fold, r.role, r.Date)
    want = {key(r): (r.x, r.c) for r in want.collect()}
    got = {key(r): tuple(r.x) for r in table.copies().collect()}
    assert got.keys() == want.keys()
    for k, (x, c) in got.items():
        assert (x, c) == (pytest.approx(want[k][0], abs=1e-6), 0.0)
    models = {r.model: r.n_train for r in table.scales.collect()}
    assert sum(models.values()) == sum(k[2] == "train" for k in want) and len(models) == len({k[:2] for k in want if k[2] == "train"})
