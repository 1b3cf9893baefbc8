"""The decay sweep: every configuration in one pass over the scored news.

An intraday weight depends only on the minute of the session, so the news is
first reduced to one row per (entity, day, session minute); a sum of weighted
scores over news equals the sum over those minutes. Only this bounded table is
multiplied by the configurations, never the news.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions.decay import HalfLifeDecay, make_decay, weight_column
from signalspark.operators.daily import (
    KEYS, SCORE, TIME_01, weighted_moments, with_normalized_time)
from signalspark.operators.features import (
    TICKER, add_sentiment_features, feature_names, fill_features)
from signalspark.operators.fold_table import fold_table
from signalspark.operators.metrics import compare
from signalspark.operators.models import MODELS
from signalspark.operators.recurrence import decaying_sum
from signalspark.params import FoldParams, SweepParams, TradingParams

CONFIG = ("config_id", "decay_type", "param_name", "param_value")


def config_table(spark: SparkSession, params: SweepParams = SweepParams()) -> DataFrame:
    """The configurations as a table (34 rows by default)."""
    return spark.createDataFrame(
        params.configs(), "config_id int, decay_type string, param_name string, param_value double")


def minute_totals(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Items, scored items, and sums of the score and its square per key and session minute."""
    s = F.col(SCORE)
    return (with_normalized_time(scored).groupBy(*keys, TIME_01)
            .agg(F.count(F.lit(1)).alias("items"), F.count(s).alias("n"),
                 F.sum(s).alias("s1"), F.sum(s * s).alias("s2"), F.min(s).alias("lo"), F.max(s).alias("hi")))


def _with_configs(df: DataFrame, entries: list[Column]) -> DataFrame:
    """Each row once per configuration; the configurations are literals of the plan."""
    exploded = df.withColumn("_config", F.explode(F.array(*entries)))
    return exploded.select(*df.columns, "_config.*")


def sweep_daily(scored: DataFrame, params: SweepParams = SweepParams(),
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Daily decay features of all configurations, keyed by ``config_id``.

    Intraday configurations give sent_decay_mean, sent_decay_var, sent_flat_mean,
    sent_std and sent_count; half-life ones give sent_mean and sentiment_memory.
    """
    return sweep_minutes(minute_totals(scored, keys), params, keys)


def merged_minutes(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``minute_totals`` of all news from those of any split of it, in any order."""
    return parts.groupBy(*keys, TIME_01).agg(*[F.sum(c).alias(c) for c in ("items", "n", "s1", "s2")],
                                             F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def sweep_minutes(minutes: DataFrame, params: SweepParams = SweepParams(), keys: Sequence[str] = KEYS) -> DataFrame:
    """``sweep_daily`` from minute totals."""
    intraday, memory = [], []
    for config_id, kind, _, value in params.configs():
        decay = make_decay(kind, value)
        cid = F.lit(config_id).alias("config_id")
        if isinstance(decay, HalfLifeDecay):
            memory.append(F.struct(cid, F.lit(decay.alpha).alias("_a"), F.lit(decay.keep).alias("_q")))
        else:
            intraday.append(F.struct(cid, weight_column(decay, F.col(TIME_01)).alias("_w")))
    parts = []
    if intraday:
        w = F.col("_w")
        sums = _with_configs(minutes, intraday).groupBy("config_id", *keys).agg(
            F.sum(w * F.col("items")).alias("w"), F.sum(w * F.col("n")).alias("w_scored"),
            F.sum(w * F.col("s1")).alias("ws"), F.sum(w * F.col("s2")).alias("wss"),
            F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
        spread = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1))
        parts.append(sums.select(
            "config_id", *keys, *weighted_moments(), F.try_divide(s1, n).alias("sent_flat_mean"),
            F.when(n > 1, F.sqrt(spread)).alias("sent_std"), n.alias("sent_count")))
    if memory:
        daily = (minutes.groupBy(*keys).agg(F.try_divide(F.sum("s1"), F.sum("n")).alias("sent_mean"))
                 .filter(F.col("sent_mean").isNotNull()))
        day = F.unix_date(keys[-1]).cast("long")
        series = decaying_sum(_with_configs(daily, memory),
                              {"sentiment_memory": (F.col("sent_mean"), F.col("_a"), F.col("_q"))},
                              day, ["config_id", *keys[:-1]])
        parts.append(series.select("config_id", *keys, "sent_mean", "sentiment_memory"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sweep_market(market: DataFrame, daily: DataFrame, params: SweepParams = SweepParams(),
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Every market day once per configuration, with that configuration's sentiment."""
    entries = [F.struct(F.lit(c[0]).alias("config_id")) for c in params.configs()]
    return _with_configs(market, entries).join(daily, ["config_id", *keys], "left")


def sweep_feature_table(technical: DataFrame, daily: DataFrame,
                        params: SweepParams = SweepParams()) -> DataFrame:
    """Model features of all configurations from the shared technical table."""
    merged = sweep_market(technical, daily, params)
    by = ("config_id", *TICKER)
    return fill_features(add_sentiment_features(merged, "decay", by), by)


def sweep_predictions(technical: DataFrame, daily: DataFrame, params: SweepParams = SweepParams(),
                      folds: FoldParams = FoldParams(), model: str = "boosted_trees") -> DataFrame:
    """Out-of-fold predictions of every configuration by one of ``MODELS``.

    ``technical`` is the written table of technical features with target. All
    models, (configuration, fold) pairs, are fitted together.
    """
    table = sweep_feature_table(technical, daily, params)
    features = feature_names(table.columns)
    rows = fold_table(table, features, folds, ["config_id"], "decay_sentiment")
    return MODELS[model](rows, ["config_id"])


def sweep_metrics(predictions: DataFrame, params: SweepParams = SweepParams(),
                  trading: TradingParams = TradingParams()) -> DataFrame:
    """Fold-averaged metrics of each configuration, next to its parameter."""
    configs = F.broadcast(config_table(predictions.sparkSession, params))
    return configs.join(compare(predictions, ["config_id"], trading), "config_id")


def sweep_curve(metrics: DataFrame, metric: str = "sharpe_ratio") -> DataFrame:
    """Metric per parameter value and decay type."""
    return metrics.select(*CONFIG, F.col(f"{metric}_mean").alias("metric_value"))


def best_config(metrics: DataFrame, metric: str = "metric_value") -> DataFrame:
    """The configuration with the highest metric; the smaller id wins a tie."""
    best = F.max_by(F.struct(*CONFIG, metric), F.struct(F.col(metric), -F.col("config_id")))
    return metrics.filter(F.col(metric).isNotNull()).agg(best.alias("best")).select("best.*")


def grid_summary(rows: DataFrame, params: SweepParams = SweepParams()) -> DataFrame:
    """Configurations with the number of folds that were evaluated."""
    folds = rows.groupBy("config_id").agg(F.count_distinct("fold").alias("n_folds"))
    configs = F.broadcast(config_table(rows.sparkSession, params))
    return configs.join(folds, "config_id").select(*CONFIG, "n_folds")
