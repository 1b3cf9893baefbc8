"""Headlines with a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.sources.checks import require_columns
from signalspark.sources.market import read_table

# Columns of a headline file.
NEWS_COLUMNS = ("Headlines", "Time", "Description")


def dedupe_news(df: DataFrame) -> DataFrame:
    """One row per (Headlines, Time): the one with the smallest description.

    The other columns come along with the kept row. It is an aggregate rather
    than a ranked window, so a headline copied a billion times is reduced inside
    each map task before anything is shuffled.
    """
    rest = [c for c in df.columns if c not in ("Headlines", "Time")]
    rest.sort(key=lambda c: c != "Description")
    kept = F.min(F.struct(F.col(rest[0]).isNull().alias("absent"), *rest)).alias("kept")
    return (df.groupBy("Headlines", "Time").agg(kept)
            .select(*[F.col(f"kept.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]))


def load_news(spark: SparkSession, path: str) -> DataFrame:
    """Typed and deduplicated headlines."""
    df = require_columns(read_table(spark, path), NEWS_COLUMNS)
    typed = df.withColumn("Time", F.to_timestamp_ntz(F.col("Time").cast("string")))
    return dedupe_news(typed)
