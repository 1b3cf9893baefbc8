"""Technical indicators per ticker over daily bars.

Every window is partitioned by ``Ticker`` and ordered by ``Date``, so Spark plans
one exchange for the whole chain. The rows of one ticker are bounded by the days
of its history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from signalspark.operators.recurrence import decaying_sum

# Default look-back periods in rows.
RETURN_PERIODS = (1, 5, 10)
VOLATILITY_ROWS = 20
RSI_ROWS = 14
MACD_ROWS = (12, 26, 9)
EMA_ROWS = (12, 26)
MOMENTUM_ROWS = 10

# The columns a full indicator table adds and a fill step covers.
FILLED_TECHNICAL = ("RSI", "MACD", "MACD_signal", "MACD_diff", "EMA_12", "EMA_26",
                    "Momentum", "volatility", "return_1d", "return_5d", "return_10d")


def by_day(keys: Sequence[str] = ("Ticker",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("Date")


def rate_of_change(rows: int, w: WindowSpec) -> Column:
    """Close against the close ``rows`` rows ago; null where there is none or it is zero."""
    return F.try_divide(F.col("Close"), F.lag("Close", rows).over(w)) - F.lit(1.0)


def add_returns(bars: DataFrame, periods: Sequence[int] = RETURN_PERIODS,
                keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """return_{n}d and its log1p (null at -100 % and below)."""
    w = by_day(keys)
    out = bars.withColumns({f"return_{n}d": rate_of_change(n, w) for n in periods})
    return out.withColumns({f"log_return_{n}d": F.log1p(f"return_{n}d") for n in periods})


def add_volatility(bars: DataFrame, rows: int = VOLATILITY_ROWS,
                   keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Rolling sample std of the 1-row return."""
    if "return_1d" not in bars.columns:
        bars = bars.withColumn("return_1d", rate_of_change(1, by_day(keys)))
    frame = by_day(keys).rowsBetween(-(rows - 1), Window.currentRow)
    return bars.withColumn("volatility", F.stddev_samp("return_1d").over(frame))


def add_momentum(bars: DataFrame, rows: int = MOMENTUM_ROWS,
                 keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Rate of change over ``rows`` rows."""
    return bars.withColumn("Momentum", rate_of_change(rows, by_day(keys)))


def _ema_spec(x: Column, span: int) -> tuple[Column, float, float]:
    alpha = 2.0 / (span + 1.0)
    return x, alpha, 1.0 - alpha


def add_ema(bars: DataFrame, spans: Sequence[int] = EMA_ROWS,
            keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """EMA_{n}: starts at the first close, alpha = 2 / (n + 1)."""
    return _smooth(bars, keys, ema=spans)


def add_rsi(bars: DataFrame, rows: int = RSI_ROWS, keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Wilder's relative strength index; null for the first ``rows - 1`` rows."""
    return _smooth(bars, keys, rsi=rows)


def add_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9,
             keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """MACD, its signal line and their difference, null until enough rows are seen."""
    return _smooth(bars, keys, macd=(fast, slow, signal))


def add_all_indicators(bars: DataFrame, keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Returns, volatility, RSI, MACD, EMAs and momentum."""
    out = add_volatility(add_returns(bars, keys=keys), keys=keys)
    out = add_momentum(out, keys=keys)
    return _smooth(out, keys, ema=EMA_ROWS, rsi=RSI_ROWS, macd=MACD_ROWS)


def _smooth(bars: DataFrame, keys: Sequence[str], ema: Sequence[int] = (),
            rsi: int | None = None, macd: tuple[int, int, int] | None = None) -> DataFrame:
    """The exponentially smoothed indicators; all averages of the close run in one pass."""
    w = by_day(keys)
    close = F.col("Close")
    out = bars.withColumn("_row", F.row_number().over(w))
    averages = {f"EMA_{n}": _ema_spec(close, n) for n in ema}
    if macd:
        averages |= {"_fast": _ema_spec(close, macd[0]), "_slow": _ema_spec(close, macd[1])}
    if rsi:
        step = F.coalesce(close - F.lag("Close").over(w), F.lit(0.0))
        out = out.withColumns({"_up": F.greatest(step, F.lit(0.0)),
                               "_down": F.greatest(-step, F.lit(0.0))})
        alpha = 1.0 / rsi
        averages |= {"_gain": (F.col("_up"), alpha, 1.0 - alpha),
                     "_loss": (F.col("_down"), alpha, 1.0 - alpha)}
    out = decaying_sum(out, averages, F.col("_row"), keys)
    added = [f"EMA_{n}" for n in ema]
    if rsi:
        strength = F.try_divide("_gain", "_loss")
        index = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + strength))
        out = out.withColumn("RSI", F.when(F.col("_row") >= rsi, index))
        added.append("RSI")
    if macd:
        _, slow, signal = macd
        line = F.when(F.col("_row") >= slow, F.col("_fast") - F.col("_slow"))
        out = out.withColumn("MACD", line)
        out = decaying_sum(out, {"_signal": _ema_spec(F.col("MACD"), signal)}, F.col("_row"), keys)
        out = out.withColumn("MACD_signal",
                             F.when(F.col("_row") >= slow + signal - 1, F.col("_signal")))
        out = out.withColumn("MACD_diff", F.col("MACD") - F.col("MACD_signal"))
        added += ["MACD", "MACD_signal", "MACD_diff"]
    return out.select(*[c for c in bars.columns if c not in added], *added)
