import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalspark.functions.clock import normalized_time
from signalspark.functions.decay import ExponentialDecay, HalfLifeDecay, LinearDecay, make_decay
from signalspark.operators.align import align_news
from signalspark.operators.daily import (
    apply_decay, daily_sentiment, decay_daily, half_life_memory, weighted_variance)
from signalspark.operators.joins import hot_keys, lookup_join
from signalspark.operators.recurrence import decaying_sum
from signalspark.params import SweepParams
from signalspark.plans.sweep import sweep_daily

BAR = "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double"


def bars_of(spark, days):
    return spark.createDataFrame([(t, d, 1.0, 2.0, 0.5, 1.5, 9.0) for t, d in days], BAR)


def test_forward_roll_equals_brute_force_on_both_join_paths(spark):
    rng = random.Random(5)
    start = date(2024, 1, 1)
    days = sorted({(t, start + timedelta(rng.randrange(60))) for t in "AB" for _ in range(25)})
    # ticker A holds most of the news; C has no bars at all
    items = [(i, rng.choice("AAAAAB") if i else "C",
              datetime(2023, 12, 25) + timedelta(hours=rng.randrange(80 * 24))) for i in range(300)]
    news = spark.createDataFrame(items, "id int, Ticker string, Time timestamp_ntz")
    bars = bars_of(spark, days)
    want = {}
    for i, t, at in items:
        later = [d for x, d in days if x == t and d >= at.date()]
        if later:
            want[i] = min(later)
    for limits in ({}, {"max_broadcast_rows": 0},
                   {"max_broadcast_rows": 0, "sample_fraction": 1.0, "hot_share": 0.01, "salts": 5}):
        out = align_news(news, bars, salt_by=["id"], **limits).collect()
        assert {r.id: r.Date for r in out} == want and len(out) == len(want)
        assert all(r.rolled == (r.Date != r.Time.date()) and r.Date >= r.Time.date() for r in out)
    exact = align_news(news, bars, roll="exact", salt_by=["id"]).collect()
    assert {r.id for r in exact} == {i for i, t, at in items if (t, at.date()) in set(days)}
    with pytest.raises(ValueError):
        align_news(news, bars, roll="back")


def test_small_lookup_is_broadcast_and_large_one_is_salted(spark):
    news = spark.createDataFrame([(1, "A", datetime(2024, 1, 1))], "id int, Ticker string, Time timestamp_ntz")
    bars = bars_of(spark, [("A", date(2024, 1, 2))])
    small = align_news(news, bars)._jdf.queryExecution().toString()
    large = align_news(news, bars, max_broadcast_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in small and "Cartesian" not in small
    assert "_salt" in large and "_salt" not in small


def test_only_hot_keys_are_spread(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(600)]
    large = spark.createDataFrame(rows, "k string, i int")
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(600)], "k string, v int")
    found = hot_keys(large, ["k"], sample_fraction=1.0, hot_share=0.01)
    assert [r.k for r in found.collect()] == ["hot"]
    for how in ("inner", "left"):
        out = lookup_join(large, lookup, ["k"], how, ["i"], max_broadcast_rows=0, salts=4,
                          sample_fraction=1.0, hot_share=0.01)
        assert sorted(map(tuple, out.collect())) == sorted(
            (k, i, 1 if k == "hot" else i) for k, i in rows)


def test_session_clock(spark):
    cases = [("2024-01-06 18:00:00", 1.0), ("2024-01-05 09:30:59", 0.0), ("2024-01-05 16:00:00", 1.0),
             ("2024-01-05 00:00:00", 0.0), ("2024-01-05 12:45:00", 0.5), (None, None)]
    df = spark.createDataFrame(cases, "s string, want double").withColumn("t", F.to_timestamp_ntz("s"))
    for r in df.select("want", normalized_time("t").alias("got"),
                       normalized_time("t", F.lit(True), 0.0).alias("rolled")).collect():
        assert r.got == r.want and r.rolled == 0.0


def test_weights(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "t double")
    got = df.select("t", ExponentialDecay(1.0).weight(F.col("t")).alias("e"),
                    LinearDecay(0.5).weight(F.col("t")).alias("l")).orderBy("t").collect()
    assert [r.e for r in got] == pytest.approx([math.exp(-1), math.exp(-0.5), 1.0])
    assert [r.l for r in got] == [0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        make_decay("cubic", 1.0)


def scored_rows(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice("AAB"), date(2024, 1, 1) + timedelta(rng.randrange(40)), rng.choice([0.0, 0.25, 0.5, 1.0]),
             rng.uniform(-1, 1)) for _ in range(n)] + [("A", date(2024, 5, 1), 0.0, 0.3)]
    return spark.createDataFrame(
        rows, "Ticker string, Date date, normalized_time double, sentiment_score double"), rows


def test_decay_aggregates_equal_brute_force(spark):
    df, rows = scored_rows(spark)
    groups = {}
    for t, d, x, s in rows:
        groups.setdefault((t, d), []).append((math.exp(-2 * (1 - x)), s))
    got = {(r.Ticker, r.Date): r for r in decay_daily(df, ExponentialDecay(2.0)).collect()}
    assert got.keys() == groups.keys()
    for k, items in groups.items():
        w = sum(a for a, _ in items)
        mean = sum(a * s for a, s in items) / w
        assert got[k].sent_decay_mean == pytest.approx(mean)
        assert got[k].sent_decay_var == pytest.approx(sum(a * (s - mean) ** 2 for a, s in items) / w, abs=1e-12)
        assert got[k].sent_count == len(items)
        assert (got[k].sent_std is None) == (len(items) == 1)
    # no decay is the flat mean; weights that are all zero give null
    for r in decay_daily(df, LinearDecay(0.0)).collect():
        assert r.sent_decay_mean == pytest.approx(r.sent_flat_mean)
    last = decay_daily(df, LinearDecay(1.0)).filter(F.col("Date") == "2024-05-01").first()
    assert last.sent_decay_mean is None and last.sent_decay_var is None
    custom = decay_daily(df, lambda t: t * t)
    assert custom.count() == len(groups)
    assert weighted_variance(df, LinearDecay(0.5)).columns == ["Ticker", "Date", "sent_decay_var"]


def test_daily_spread_of_one_item_is_zero(spark):
    df = spark.createDataFrame([("A", date(2024, 1, 1), 0.4, 0.6, 0.2, 0.2)],
                               "Ticker string, Date date, sentiment_score double, positive double, "
                               "negative double, neutral double")
    row = daily_sentiment(df).first()
    assert (row.sent_std, row.sent_count, row.positive_mean) == (0.0, 1, 0.6)


def test_memory_of_constant_score_keeps_its_value_at_daily_gaps(spark):
    rows = [("A", date(2024, 1, 1) + timedelta(i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, sent_mean double")
    got = half_life_memory(df, HalfLifeDecay(3.0)).orderBy("Date").collect()
    assert [r.sentiment_memory for r in got] == pytest.approx([1.0] * 10)


@pytest.mark.parametrize("h", [0.5, 3.0, 21.0])
def test_recurrence_equals_sequential_loop_over_many_blocks(spark, h):
    rng = random.Random(7)
    decay, day, rows = HalfLifeDecay(h), 0, []
    for _ in range(3000):
        day += rng.choice([1, 1, 1, 3, 4])
        rows.append(("A", date(1990, 1, 1) + timedelta(day), rng.uniform(-1, 1)))
    rows.append(("A", date(2200, 1, 1), 0.5))  # after a gap of many half-lives
    df = spark.createDataFrame(rows, "Ticker string, Date date, sent_mean double")
    got = {r.Date: r.sentiment_memory for r in half_life_memory(df, decay).collect()}
    m, last = rows[0][2], rows[0][1]
    for _, d, s in rows[1:]:
        m, last = decay.alpha * s + decay.keep ** (d - last).days * m, d
        assert got[d] == pytest.approx(m, abs=1e-11)


def test_recurrence_starts_at_first_value(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 3, 8.0)], "k int, p int, x double")
    out = decaying_sum(df, {"y": (F.col("x"), 0.5, 0.5)}, F.col("p"), ["k"]).orderBy("p").collect()
    assert [r.y for r in out] == [None, 4.0, 6.0]


def test_sweep_in_one_pass_equals_each_configuration(spark):
    df, _ = scored_rows(spark, 150)
    params = SweepParams(exponential=(0.5, 2.0), half_life=(1.0, 7.0), linear=(1.0,))
    swept = sweep_daily(df, params).cache()
    for config_id, kind, _, value in params.configs():
        alone = {(r.Ticker, r.Date): r for r in apply_decay(df, kind, value).collect()}
        mine = {(r.Ticker, r.Date): r for r in swept.filter(F.col("config_id") == config_id).collect()}
        assert alone.keys() == mine.keys()
        for k, r in alone.items():
            for c in r.__fields__[2:]:
                want = r[c]
                assert mine[k][c] is None if want is None else mine[k][c] == pytest.approx(want, abs=1e-9)


def test_constant_scores_have_no_spread(spark):
    rows = [("A", date(2024, 1, 2), datetime(2024, 1, 2, 10, m), 0.1) for m in range(50)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Time timestamp_ntz, sentiment_score double")
    daily = sweep_daily(df, SweepParams(exponential=(0.7,), half_life=(), linear=())).first()
    assert (daily.sent_std, daily.sent_decay_var) == (0.0, 0.0)
    assert decay_daily(df, ExponentialDecay(0.7)).first().sent_decay_var == 0.0
