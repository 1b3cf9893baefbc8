"""Decay features from batches in any order against those of all news at once."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalspark.functions.decay import HalfLifeDecay
from signalspark.operators.daily import half_life_memory
from signalspark.params import SweepParams
from signalspark.plans.sweep import sweep_daily
from signalspark.streaming.decay import SCORED, DecayStore, follow_decay, memory_state, merge_states, newest_memory

FEW = SweepParams(exponential=(0.5, 3.0), half_life=(2.0,), linear=(0.7,))


def news(seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        day = date(2024, 1, 1) + timedelta(rng.choice([0, 1, 2, 9, 40, rng.randrange(60)]))
        at = datetime(day.year, day.month, day.day, rng.randrange(24), rng.choice([0, 15]))
        rows.append((rng.choice(["A", "A", "B", None]), day, at, None if rng.random() < 0.1 else round(rng.uniform(-1, 1), 3)))
    return rows


def shown(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()], key=str)


@pytest.mark.parametrize("fold_after", [1, 50])
def test_any_split_equals_one_run(spark, tmp_path, fold_after):
    rows = news()
    table = spark.createDataFrame(rows, SCORED)
    want = shown(sweep_daily(table, FEW))
    random.Random(fold_after).shuffle(rows)
    store = DecayStore(spark, str(tmp_path / "s"), fold_after)
    assert store.minutes().count() == 0
    for k, start in enumerate(range(0, 400, 100)):
        part = spark.createDataFrame(rows[start:start + 100], SCORED)
        store.add(part, k)
        store.add(part, k)  # replayed
    assert shown(store.features(FEW)) == want


def test_stream_takes_new_files_only(spark, tmp_path):
    rows = news(5)
    folder, where = str(tmp_path / "in"), str(tmp_path / "store")
    for part in (rows[:150], rows[150:200], rows[200:]):
        spark.createDataFrame(part, SCORED).coalesce(1).write.mode("append").parquet(folder)
        follow_decay(spark, folder, where, str(tmp_path / "c"), fold_after=1).awaitTermination()
    assert shown(DecayStore(spark, where).features(FEW)) == shown(sweep_daily(spark.createDataFrame(rows, SCORED), FEW))


def test_memory_takes_late_and_changed_days(spark):
    decay = HalfLifeDecay(2.0)
    start = date(2024, 1, 1)
    days = [("A", k, k / 7 - 1) for k in (3, 4, 9, 30, 31)] + [("B", 5, 0.5), (None, 2, -0.25), ("C", 1, None)]
    # later: a new first day, a day between, a new last day, and the first day of B with another mean
    late = [("A", 0, 0.9, None), ("A", 12, -0.4, None), ("A", 33, 0.2, None), ("A", 9, 0.7, 9 / 7 - 1), ("B", 5, 0.1, 0.5)]
    made = lambda rows: spark.createDataFrame([(t, start + timedelta(d), s) for t, d, s in rows], "Ticker string, Date date, sent_mean double")
    first = memory_state(made(days), decay, 0)
    changes = spark.createDataFrame([(t, start + timedelta(d), s, b) for t, d, s, b in late], "Ticker string, Date date, sent_mean double, old double")
    second = memory_state(changes, decay, 1, before="old")
    merged = merge_states(first.unionByName(second), decay)
    got = {r.Ticker: (r.Date, r.sentiment_memory) for r in newest_memory(merged, decay).collect()}
    final = {(t, d): s for t, d, s in days} | {(t, d): s for t, d, s, _ in late}
    whole = half_life_memory(made([(t, d, s) for (t, d), s in final.items() if s is not None]), decay)
    last = {r.Ticker: (r.Date, r.sentiment_memory) for r in whole.orderBy("Date").collect()}
    assert got.keys() == last.keys() == {"A", "B", None}
    for t, (day, value) in last.items():
        assert got[t] == (day, pytest.approx(value, abs=1e-12))
    other = merge_states(second.unionByName(merge_states(first, decay)), decay)
    assert {r.Ticker: round(r.sentiment_memory, 12) for r in newest_memory(other, decay).collect()} == {t: round(v, 12) for t, (_, v) in got.items()}
