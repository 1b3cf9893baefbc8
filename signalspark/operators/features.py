"""Feature tables: market bars with sentiment columns and their derivatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.indicators import FILLED_TECHNICAL, add_all_indicators, by_day

# Sentiment columns by type, look-backs, and columns that are no features.
SENTIMENT_COLUMNS = {
    "flat": ("sent_mean", "sent_std", "sent_min", "sent_max", "sent_count"),
    "decay": ("sent_decay_mean", "sent_decay_var", "sentiment_memory"),
}
LAGS = (1, 2, 3)
MOMENTUM_ROWS = 3
VOLATILITY_ROWS = 5
CLASS_MEANS = ("positive_mean", "negative_mean", "neutral_mean")
NOT_FEATURES = frozenset((
    "Date", "Ticker", "Target", "Open", "High", "Low", "Close", "Volume", "Headlines", "Time",
    "Description", "Date_only", "Next_Close", "negative", "neutral", "positive",
    "sentiment_score", "decay_weight", "normalized_time", "combined_text"))
# Ours: key columns of a sweep, the return a prediction earns, and the roll flag.
NOT_FEATURES_HERE = frozenset(("config_id", "decay_type", "param_name", "param_value",
                               "fwd_return", "rolled"))
TICKER = ("Ticker",)


def add_target(bars: DataFrame, keys: Sequence[str] = TICKER) -> DataFrame:
    """Target 1 if the next close is higher, and ``fwd_return`` to it; last day dropped."""
    nxt = F.lead("Close").over(by_day(keys))
    out = bars.withColumn("_next", nxt).filter(F.col("_next").isNotNull())
    return out.withColumns({
        "Target": (F.col("_next") > F.col("Close")).cast("int"),
        "fwd_return": F.try_divide("_next", "Close") - F.lit(1.0)}).drop("_next")


def merge_sentiment(market: DataFrame, sentiment: DataFrame,
                    keys: Sequence[str] = ("Ticker", "Date")) -> DataFrame:
    """All market days, with sentiment where there is news."""
    return market.join(sentiment, list(keys), "left")


def add_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = LAGS,
             keys: Sequence[str] = TICKER) -> DataFrame:
    """{column}_lag{k} for the columns that exist."""
    w = by_day(keys)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w)
                           for c in columns if c in df.columns for k in lags})


def add_sentiment_momentum(df: DataFrame, column: str = "sent_mean", rows: int = MOMENTUM_ROWS,
                           keys: Sequence[str] = TICKER, name: str = "sent_momentum") -> DataFrame:
    """Change against ``rows`` rows ago."""
    if column not in df.columns:
        return df
    return df.withColumn(name, F.col(column) - F.lag(column, rows).over(by_day(keys)))


def add_sentiment_volatility(df: DataFrame, column: str = "sent_mean",
                             rows: int = VOLATILITY_ROWS, keys: Sequence[str] = TICKER,
                             name: str = "sent_volatility") -> DataFrame:
    """Rolling sample std over ``rows`` rows."""
    if column not in df.columns:
        return df
    frame = by_day(keys).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumn(name, F.stddev_samp(column).over(frame))


def add_sentiment_features(df: DataFrame, kind: str = "flat",
                           keys: Sequence[str] = TICKER) -> DataFrame:
    """Lags of the sentiment columns, momentum and volatility of the mean column."""
    if kind not in SENTIMENT_COLUMNS:
        raise ValueError(f"Unknown sentiment type: {kind}")
    present = [c for c in SENTIMENT_COLUMNS[kind] if c in df.columns]
    if not present:
        return df
    out = add_lags(df, present, keys=keys)
    means = [c for c in present if "mean" in c]
    for c in means:
        suffix = "" if len(means) == 1 else f"_{c}"
        out = add_sentiment_momentum(out, c, keys=keys, name=f"sent_momentum{suffix}")
        out = add_sentiment_volatility(out, c, keys=keys, name=f"sent_volatility{suffix}")
    return out


def fill_features(df: DataFrame, keys: Sequence[str] = TICKER,
                  strict_parity: bool = False) -> DataFrame:
    """Carry sentiment and technical columns forward per ticker, then 0.

    The class means are set to 0 on days without news, so that such days stay in
    the training matrix; ``strict_parity`` leaves them null.
    """
    past = by_day(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = [c for c in df.columns if "sent" in c.lower() or c in FILLED_TECHNICAL]
    zero = {c: F.lit(0).cast(df.schema[c].dataType) for c in carried}
    out = df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past), zero[c])
                          for c in carried})
    means = [] if strict_parity else [c for c in CLASS_MEANS if c in df.columns]
    return out.fillna(0.0, subset=means) if means else out


def prepare_features(df: DataFrame, kind: str | None = "flat", keys: Sequence[str] = TICKER,
                     strict_parity: bool = False) -> DataFrame:
    """Technical indicators, then sentiment features of ``kind`` (None for none), then fills."""
    out = add_all_indicators(df, keys)
    if kind is not None:
        out = add_sentiment_features(out, kind, keys)
    return fill_features(out, keys, strict_parity)


def technical_table(market: DataFrame, keys: Sequence[str] = TICKER) -> DataFrame:
    """Market days with filled technical indicators; the same for every variant and sweep."""
    return fill_features(add_all_indicators(market, keys), keys)


def with_sentiment(technical: DataFrame, daily: DataFrame, kind: str,
                   keys: Sequence[str] = TICKER, strict_parity: bool = False) -> DataFrame:
    """Feature table of a variant from the technical table and its daily sentiment.

    Filling works column by column, so the result equals ``prepare_features`` on
    the merged table.
    """
    merged = merge_sentiment(technical, daily, [*keys, "Date"])
    return fill_features(add_sentiment_features(merged, kind, keys), keys, strict_parity)


def feature_names(columns: Sequence[str], include_sentiment: bool = True) -> list[str]:
    """Columns a model may use, in table order."""
    names = [c for c in columns if c not in NOT_FEATURES | NOT_FEATURES_HERE]
    return names if include_sentiment else [c for c in names if "sent" not in c.lower()]


def model_matrix(df: DataFrame, features: Sequence[str], target: str = "Target") -> DataFrame:
    """Rows with a target and all features."""
    return df.na.drop(subset=[target, *features])
