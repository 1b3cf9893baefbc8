import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalspark import storage
from signalspark.operators.models import MODELS, boosted_trees, cv_estimator_rows
from signalspark.operators.scoring import score_lexicon, with_text
from signalspark.params import FoldParams, StudyParams, SweepParams
from signalspark.plans.study import Study
from signalspark.plans.sweep import best_config, sweep_daily, sweep_predictions
from signalspark.sources.market import load_all_bars, load_bars, standardize_bars
from signalspark.sources.news import dedupe_news, load_news
from signalspark.storage import materialize, work_dir


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_bar_files(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Volume\n"
    a = write(tmp_path / "a.csv", head + "2024-01-03,1,2,0,1.5,10\n2024-01-02,1,2,0,1.25,10\n"
                                         "2024-01-02,9,9,9,9,9\n2024-01-04,1,1,1,,5\n")
    b = write(tmp_path / "b.csv", head + "2024-01-02,5,6,4,5.5,7\n")
    got = load_all_bars(spark, {"AAPL": a, "MSFT": b}).orderBy("Ticker", "Date").collect()
    assert [(r.Ticker, r.Date, r.Close) for r in got] == [
        ("AAPL", date(2024, 1, 2), 1.25), ("AAPL", date(2024, 1, 3), 1.5),
        ("AAPL", date(2024, 1, 4), None), ("MSFT", date(2024, 1, 2), 5.5)]  # a day without a close stays a day
    folder = tmp_path / "other"
    folder.mkdir()
    same = write(folder / "a.csv", head + "2024-01-05,5,6,4,5.5,7\n")  # a file name that repeats
    assert load_all_bars(spark, {"AAPL": a, "MSFT": same}).count() == 4
    assert load_all_bars(spark, {"AAPL": a, "MSFT": b}, fmt="csv").count() == 4
    plain = write(tmp_path / "prices", head + "2024-01-05,5,6,4,5.5,7\n")
    assert load_bars(spark, "X", plain, fmt="csv").first().Close == 5.5
    bad = write(tmp_path / "c.csv", "Date,Open,Close\n2024-01-01,1,1\n")
    with pytest.raises(ValueError, match="High.*Low.*Volume"):
        load_bars(spark, "X", bad)
    nan = spark.createDataFrame([("A", date(2024, 1, 1), 1.0, 1.0, 1.0, float("nan"), 1.0)],
                                "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double")
    assert [r.Close for r in standardize_bars(nan).collect()] == [None]


def test_news_file(spark, tmp_path):
    path = write(tmp_path / "n.csv", 'Headlines,Time,Description\n"A, b",2024-01-02 10:00:00,z\n'
                                     '"A, b",2024-01-02 10:00:00,y\n"A, b",2024-01-02 10:01:00,\nQ,2024-01-03,x\n')
    got = load_news(spark, path).orderBy("Time").collect()
    assert [(r.Headlines, r.Description) for r in got] == [("A, b", "y"), ("A, b", None), ("Q", "x")]
    assert got[0].Time == datetime(2024, 1, 2, 10)
    with pytest.raises(ValueError, match="Time"):
        load_news(spark, write(tmp_path / "m.csv", "Headlines,Description\na,b\n"))


def test_dedupe_prefers_a_description_and_keeps_other_columns(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "h", t, None), (2, "h", t, "b"), (3, "h", t, "a"), (4, "k", t, None)],
                               "id int, Headlines string, Time timestamp_ntz, Description string")
    assert sorted((r.id, r.Description) for r in dedupe_news(df).collect()) == [(3, "a"), (4, None)]


def test_written_tables_go_to_the_shared_folder(spark):
    df = materialize(spark.range(3).toDF("a"), "numbers")
    assert df.count() == 3 and all(work_dir(spark) in f for f in df.inputFiles())


def test_local_sessions_fall_back_to_one_temporary_folder(spark, monkeypatch):
    monkeypatch.setattr(storage, "CHECKPOINT_CONF", "spark.checkpoint.dir.unset")
    first = work_dir(spark)
    assert first == work_dir(spark) and "signalspark-" in first
    assert materialize(spark.range(2).toDF("a")).count() == 2

    class Cluster:
        conf = spark.conf
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(Cluster())


def test_best_configuration(spark):
    rows = [(0, "linear", "beta", 0.1, 0.5), (1, "linear", "beta", 0.2, 0.9), (2, "linear", "beta", 0.3, 0.9),
            (3, "linear", "beta", 0.4, None)]
    df = spark.createDataFrame(rows, "config_id int, decay_type string, param_name string, param_value double, metric_value double")
    assert best_config(df).first().config_id == 1


def test_small_study_end_to_end(spark, tmp_path, monkeypatch):
    few = lambda n: boosted_trees(n, maxIter=2)
    monkeypatch.setitem(MODELS, "boosted_trees", lambda rows, keys=(): cv_estimator_rows(rows, few, "boosted_trees", keys))
    rng = random.Random(9)
    start, bars, news = date(2024, 1, 1), [], []
    for i in range(90):
        day = start + timedelta(i)
        for t in ("AAPL", "MSFT"):
            if day.weekday() < 5:
                p = 100 + rng.gauss(0, 3)
                bars.append((t, day, p, p + 1, p - 1, p + rng.gauss(0, 1), 1e3))
            if rng.random() < 0.7:
                word = rng.choice(["gain", "loss", "flat"])
                news.append((f"{'Apple' if t == 'AAPL' else 'Azure'} {word} {i}",
                             datetime(day.year, day.month, day.day, rng.randrange(24)), None))
    bars = spark.createDataFrame(bars, "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double")
    news = spark.createDataFrame(news, "Headlines string, Time timestamp_ntz, Description string")
    params = StudyParams(folds=FoldParams(25, 6, 3),
                         sweep=SweepParams(exponential=(1.0,), half_life=(2.0,), linear=(0.5,)))
    study = Study(params).prepare(bars, news)
    scorer = lambda df: score_lexicon(with_text(df), "combined_text", ("gain",), ("loss",))
    with pytest.raises(ValueError, match="shap"):
        study.run(scorer, skip=["shap"])
    study.run(scorer)
    comparison = study.tables["comparison"].collect()
    assert sorted((r.Model, r.model_type) for r in comparison) == [
        (v, m) for v in ("Baseline", "Decay Sentiment", "Flat Sentiment") for m in ("boosted_trees", "logistic_regression")]
    assert all(0 <= r.auc_mean <= 1 and r.max_drawdown_mean <= 0 for r in comparison)
    assert {r.n_folds for r in study.tables["grid_summary"].collect()} == {3}
    best = study.tables["best_config"].first()
    assert (study.params.decay_type, study.params.decay_value) == (best.decay_type, best.param_value)
    written = study.report(str(tmp_path / "out"))
    assert len(written) == 11
    assert spark.read.option("header", True).csv(written[0]).count() == 6
    boosted = sweep_predictions(study.tables["technical"], sweep_daily(study.tables["scored"], params.sweep), params.sweep,
                                params.folds, "boosted_trees")
    assert {r.config_id for r in boosted.select("config_id").distinct().collect()} == {0, 1, 2}
    assert boosted.filter("model_type <> 'boosted_trees'").count() == 0
    shares = {r.feature: r for r in study.tables["importance"].collect()}
    assert shares["RSI"].baseline_importance > 0 and "sent_count_lag1" not in shares
    assert any("sent" in f and r.baseline_importance == 0 for f, r in shares.items())
    assert study.tables["top_features"].count() == 10
    aligned = study.tables["aligned"]
    assert aligned.filter(F.weekday("Date") > 4).count() == 0
