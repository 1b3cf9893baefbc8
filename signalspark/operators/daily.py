"""Scores per entity and day, flat or weighted by a decay.

All of these are plain hash aggregates: every map task reduces its rows to one
partial row per key, so a key that holds a third of the news costs one partial
row per task and nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions.clock import normalized_time
from signalspark.functions.decay import HalfLifeDecay, IntradayDecay, make_decay, weight_column
from signalspark.operators.recurrence import decaying_sum

KEYS = ("Ticker", "Date")
SCORE = "sentiment_score"
TIME_01 = "normalized_time"


def daily_sentiment(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, spread, range and count of the score, and mean class shares; std 0 for one item."""
    return scored.groupBy(*keys).agg(
        F.avg(SCORE).alias("sent_mean"),
        F.coalesce(F.stddev_samp(SCORE), F.lit(0.0)).alias("sent_std"),
        F.min(SCORE).alias("sent_min"),
        F.max(SCORE).alias("sent_max"),
        F.count(SCORE).alias("sent_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("positive", "negative", "neutral")])


def intraday_sentiment(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Score mean, std and count with mean, first and last position in the session."""
    return with_normalized_time(scored).groupBy(*keys).agg(
        F.avg(SCORE).alias("sentiment_score_mean"),
        F.stddev_samp(SCORE).alias("sentiment_score_std"),
        F.count(SCORE).alias("sentiment_score_count"),
        F.avg(TIME_01).alias("normalized_time_mean"),
        F.min(TIME_01).alias("normalized_time_min"),
        F.max(TIME_01).alias("normalized_time_max"))


def with_normalized_time(df: DataFrame, off_calendar_t: float | None = None) -> DataFrame:
    """Add ``normalized_time`` unless it is there already."""
    if TIME_01 in df.columns:
        return df
    rolled = F.col("rolled") if "rolled" in df.columns else None
    return df.withColumn(TIME_01, normalized_time("Time", rolled, off_calendar_t))


def decay_daily(scored: DataFrame, decay: IntradayDecay | Callable[[Column], Column],
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted mean and variance per key next to the flat mean, sample std and count.

    The std of a day with one item stays null here (the fill step carries the
    previous one forward); a day whose weights are all zero has a null mean.
    """
    w = weight_column(decay, F.col(TIME_01))
    rows = with_normalized_time(scored).select(*keys, SCORE, w.alias("w"))
    sums = rows.groupBy(*keys).agg(
        F.sum("w").alias("w"),
        F.sum(F.when(F.col(SCORE).isNotNull(), F.col("w"))).alias("w_scored"),
        F.sum(F.col("w") * F.col(SCORE)).alias("ws"),
        F.sum(F.col("w") * F.col(SCORE) * F.col(SCORE)).alias("wss"),
        F.min(SCORE).alias("lo"), F.max(SCORE).alias("hi"),
        F.avg(SCORE).alias("sent_flat_mean"),
        F.stddev_samp(SCORE).alias("sent_std"),
        F.count(SCORE).alias("sent_count"))
    return sums.select(*keys, *weighted_moments(), "sent_flat_mean", "sent_std", "sent_count")


def weighted_moments() -> list[Column]:
    """Mean and biased variance from the sums w, w_scored, ws and wss; exactly 0 if lo and hi are equal."""
    mean = F.try_divide("ws", "w")
    spread = F.col("wss") - 2 * mean * F.col("ws") + mean * mean * F.col("w_scored")
    variance = F.try_divide(spread, F.col("w"))
    return [mean.alias("sent_decay_mean"),
            F.when(variance.isNotNull(), F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(
                F.greatest(variance, F.lit(0.0)))).alias("sent_decay_var")]


def weighted_variance(scored: DataFrame, decay: IntradayDecay | Callable[[Column], Column],
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Biased weighted variance of the score around the weighted mean, in one pass."""
    return decay_daily(scored, decay, keys).select(*keys, "sent_decay_var")


def daily_mean(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean score per key; days without any score are left out."""
    return (scored.groupBy(*keys).agg(F.avg(SCORE).alias("sent_mean"))
            .filter(F.col("sent_mean").isNotNull()))


def half_life_memory(daily: DataFrame, decay: HalfLifeDecay, score: str = "sent_mean",
                     entity: str = "Ticker", date: str = "Date") -> DataFrame:
    """Add ``sentiment_memory``: M_0 = S_0, M_i = a S_i + keep^(days since last) M_{i-1}."""
    day = F.unix_date(F.col(date)).cast("long")
    return decaying_sum(daily, {"sentiment_memory": (F.col(score), decay.alpha, decay.keep)},
                        position=day, keys=[entity])


def apply_decay(scored: DataFrame, kind: str, value: float,
                off_calendar_t: float | None = None) -> DataFrame:
    """Daily decay features of one configuration, by type name."""
    decay = make_decay(kind, value)
    if not isinstance(decay, HalfLifeDecay):
        return decay_daily(with_normalized_time(scored, off_calendar_t), decay)
    daily = daily_mean(scored) if SCORE in scored.columns else scored
    return half_life_memory(daily, decay)
