"""Market, news and scored-text views over the given tables.

The tables hold no bars and no headlines, so the views derive them row by row:
every row of the source table is used. ``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.operators.align import align_news
from signalspark.operators.daily import daily_sentiment, decay_daily, with_normalized_time
from signalspark.operators.features import (
    add_target, fill_features, merge_sentiment)
from signalspark.operators.folds import TEST, assign_folds, fold_days
from signalspark.operators.indicators import add_returns
from signalspark.operators.scoring import with_score
from signalspark.functions.decay import ExponentialDecay
from signalspark.storage import materialize

# Score of each order priority, words of the two lexicon classes,
# and the tagging dictionary over words that occur in the documents.
PRIORITY_SCORE = {"1-URGENT": 1.0, "2-HIGH": 0.5, "3-MEDIUM": 0.0, "4-NOT SPECIFIED": -0.5,
                  "5-LOW": -1.0}
POSITIVE_WORDS = ("the", "of", "de", "la", "und", "les")
NEGATIVE_WORDS = ("and", "to", "in", "der", "que", "et")
KEYWORDS = {"E0": ("NICHT", "SICH"), "E1": ("POUR", "DANS"), "E2": ("LOS", "LAS"),
            "E3": ("THIS", "FROM"), "E4": ("WITH", "WAS"), "E5": ("THE", "LE")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_of(key: str) -> Column:
    """One of six entities per key; both fact tables name entities the same way."""
    return F.concat(F.lit("E"), F.pmod(F.col(key), F.lit(6)).cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from lineitem: unit prices of the day, opened and closed in order of the key.

    All aggregates combine inside the map tasks; (order, line) is not unique, so
    price and quantity break ties.
    """
    price = (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    rows = table(spark, sf_dir, "lineitem").select(
        entity_of("l_suppkey").alias("Ticker"), F.to_date("l_shipdate").alias("Date"), price,
        "l_quantity", "l_orderkey", "l_linenumber")
    order = F.struct("l_orderkey", "l_linenumber", "price", "l_quantity")
    return rows.groupBy("Ticker", "Date").agg(
        F.min_by("price", order).alias("Open"), F.max("price").alias("High"),
        F.min("price").alias("Low"), F.max_by("price", order).alias("Close"),
        F.sum("l_quantity").alias("Volume"))


def written_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a written table, for queries that read them more than once."""
    return materialize(bars(spark, sf_dir), "bars")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday bars from events: the day's values per event type in order of the event id."""
    rows = table(spark, sf_dir, "events").filter(F.weekday("ts") < 5).select(
        F.col("event_type").alias("Ticker"), F.to_date("ts").alias("Date"), "value", "event_id")
    return rows.groupBy("Ticker", "Date").agg(
        F.min_by("value", "event_id").alias("Open"), F.max("value").alias("High"),
        F.min("value").alias("Low"), F.max_by("value", "event_id").alias("Close"),
        F.count(F.lit(1)).cast("double").alias("Volume"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines from orders, at half-hour times of the order day."""
    minutes = F.pmod(F.col("o_orderkey"), F.lit(48)).cast("int") * 30
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", entity_of("o_custkey").alias("Ticker"),
        F.timestamp_add("MINUTE", minutes, F.col("o_orderdate")).alias("Time"),
        F.col("o_orderpriority").alias("Headlines"),
        F.concat_ws(" ", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("Description"))


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with class probabilities and score by priority."""
    return with_score(priority_shares(news(spark, sf_dir)))


def priority_shares(df: DataFrame) -> DataFrame:
    """Class probabilities by priority: the fixed score is all positive or all negative."""
    score = F.lit(0.0)
    for priority, value in PRIORITY_SCORE.items():
        score = F.when(F.col("Headlines") == priority, F.lit(value)).otherwise(score)
    return df.withColumns({
        "positive": F.greatest(score, F.lit(0.0)), "negative": F.greatest(-score, F.lit(0.0)),
        "neutral": F.lit(1.0) - F.abs(score)})


def aligned_news(spark: SparkSession, sf_dir: str, market: DataFrame) -> DataFrame:
    """Scored news rolled onto the days of ``market``."""
    return align_news(scored_news(spark, sf_dir), market, salt_by=["o_orderkey"])


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored items with real clock times."""
    score = F.least(F.col("value"), F.lit(100.0)) / F.lit(50.0) - F.lit(1.0)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("Ticker"), F.col("ts").alias("Time"),
        score.alias("sentiment_score"))


def aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events rolled onto weekdays, with their position in the session."""
    days = materialize(event_bars(spark, sf_dir), "event_bars")
    rolled = align_news(scored_events(spark, sf_dir), days, salt_by=["event_id"])
    return with_normalized_time(rolled.select("event_id", "Ticker", "Date", "Time", "rolled",
                                              "sentiment_score"))


def document_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: language and source as headline, the whole text as description."""
    minutes = F.pmod(F.col("doc_id") * 7919, F.lit(1440)).cast("int")
    day = F.date_add(F.lit("1995-01-02").cast("date"), F.pmod("doc_id", F.lit(2400)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz")).alias("Time"),
        F.concat_ws(" ", "lang", "source").alias("Headlines"), F.col("text").alias("Description"))


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a class: 0 negative (toxic), 2 positive (quality), 1 neutral."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (docs.join(table(spark, sf_dir, "labels"), "doc_id")
            .select("doc_id", "text", label.cast("double").alias("label")))


def market_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market days with flat daily sentiment."""
    market = written_bars(spark, sf_dir)
    return merge_sentiment(add_target(market), daily_sentiment(aligned_news(spark, sf_dir, market)))


def market_decay(spark: SparkSession, sf_dir: str, rate: float = 1.0) -> DataFrame:
    """Market days with exponentially weighted daily sentiment."""
    market = written_bars(spark, sf_dir)
    daily = decay_daily(with_normalized_time(aligned_news(spark, sf_dir, market)),
                        ExponentialDecay(rate))
    return merge_sentiment(add_target(market), daily)


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of three fixed rules, one per variant.

    The rules need no fitting, so the whole metric chain can be checked in SQL:
    the probability is a rounded logistic of the last return (baseline), of the
    mean score, or of the decay-weighted score. Unit prices jump by multiples from
    day to day, so returns are scaled to one percent before they are compounded.
    """
    market = written_bars(spark, sf_dir)
    scored = with_normalized_time(aligned_news(spark, sf_dir, market))
    daily = daily_sentiment(scored).select("Ticker", "Date", "sent_mean")
    decayed = decay_daily(scored, ExponentialDecay(1.0)).select("Ticker", "Date", "sent_decay_mean")
    table_ = merge_sentiment(merge_sentiment(add_target(market), daily), decayed)
    filled = fill_features(add_returns(table_, [1]))
    rules = {"baseline": "return_1d", "flat_sentiment": "sent_mean",
             "decay_sentiment": "sent_decay_mean"}
    entries = [F.struct(F.lit(v).alias("variant"), F.col(c).alias("signal"))
               for v, c in rules.items()]
    days = fold_days(add_target(market))
    tests = assign_folds(filled, days).filter(F.col("role") == TEST)
    proba = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("signal"))), 3)
    return (tests.select("fold", "Ticker", "Date", F.col("Target").alias("y_true"), "fwd_return",
                         F.inline(F.array(*entries)))
            .select("variant", F.lit("rule").alias("model_type"), "fold", "Ticker", "Date", "y_true",
                    (F.round("signal", 9) > 0).cast("int").alias("y_pred"), proba.alias("proba"),
                    (F.col("fwd_return") / F.lit(100.0)).alias("fwd_return")))
