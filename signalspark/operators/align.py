"""Roll news onto trading days.

The forward as-of join is turned into an equi-join: each ticker's trading days
are expanded to a map from calendar day to the next trading day (inclusive).
The map holds at most one row per ticker and calendar day, however much news
there is, so it is the side that is broadcast or salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.joins import lookup_join
from signalspark.storage import materialize


def roll_map(bars: DataFrame) -> DataFrame:
    """(Ticker, cal_date) -> bar of that day or of the next trading day, plus the first day.

    A ticker has one bar per day, so its window holds no more rows than its
    history has days.
    """
    by_ticker = Window.partitionBy("Ticker")
    before = F.lag("Date").over(by_ticker.orderBy("Date"))
    days = bars.select("*", F.coalesce(F.date_add(before, 1), F.col("Date")).alias("_from"),
                       F.min("Date").over(by_ticker).alias("first_day"))
    return days.withColumn("cal_date", F.explode(F.sequence("_from", "Date"))).drop("_from")


def align_news(news: DataFrame, bars: DataFrame, roll: str = "forward",
               salt_by: Sequence[str] = ("Time",), **join_limits: float) -> DataFrame:
    """News with the bar of its trading day.

    ``roll="forward"``: a headline belongs to its own day if that is a trading
    day of its ticker, else to the next one; news after the last bar is dropped.
    ``roll="exact"``: news on a day without a bar is dropped. ``rolled`` tells
    whether the day was changed. ``salt_by`` and ``join_limits`` go to ``lookup_join``.
    """
    if roll == "exact":
        on_day = news.withColumn("Date", F.to_date("Time"))
        joined = lookup_join(on_day, bars, ["Ticker", "Date"], "inner", salt_by,
                             **join_limits)
        return joined.withColumn("rolled", F.lit(False))
    if roll != "forward":
        raise ValueError(f"Unknown roll: {roll}")
    days = materialize(roll_map(bars), "roll_map")
    first = days.filter(F.col("Date") == F.col("first_day")).select("Ticker", "first_day")
    own = news.withColumn("_own", F.to_date("Time"))
    clamped = (lookup_join(own, first, ["Ticker"], "inner", salt_by, **join_limits)
               .withColumn("cal_date", F.greatest("_own", "first_day")).drop("first_day"))
    joined = lookup_join(clamped, days.drop("first_day"), ["Ticker", "cal_date"], "inner",
                         salt_by, **join_limits)
    return joined.withColumn("rolled", F.col("Date") != F.col("_own")).drop("cal_date", "_own")
