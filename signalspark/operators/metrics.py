"""Classification and trading metrics over the predictions table.

Predictions are long rows ``(keys..., fold, Ticker, Date, y_true, y_pred, proba,
fwd_return)``; a metric is one aggregate over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.ordered import auc
from signalspark.params import TradingParams

# Metrics that are averaged over folds.
CLASSIFICATION = ("accuracy", "f1", "auc", "precision", "recall")
TRADING = ("total_return", "sharpe_ratio", "max_drawdown", "mean_return", "std_return", "win_rate")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over the rows that have both values; NaN if one of them is constant.

    ``F.corr`` divides by the spread and so fails on a constant column in ANSI mode.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (spread == 0)
    return F.when(constant, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def classification_metrics(predictions: DataFrame, keys: Sequence[str], **limits: int) -> DataFrame:
    """Accuracy, F1, AUC and the confusion counts per key group.

    Precision, recall and the counts are null where truth and prediction know
    only one class between them.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    counts = predictions.groupBy(*keys).agg(
        *[F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).alias(name)
          for name, a, b in (("true_positive", 1, 1), ("true_negative", 0, 0),
                             ("false_positive", 0, 1), ("false_negative", 1, 0))])
    tp, tn = F.col("true_positive"), F.col("true_negative")
    fp, fn = F.col("false_positive"), F.col("false_negative")
    both = ~((tp + fp + fn == 0) | (tn + fp + fn == 0))
    rates = counts.select(
        *keys,
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        *[F.when(both, c).alias(n) for n, c in (("true_positive", tp), ("true_negative", tn),
                                                ("false_positive", fp), ("false_negative", fn))],
        F.when(both, F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))).alias("precision"),
        F.when(both, F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))).alias("recall"))
    return rates.join(auc(predictions, keys, **limits), list(keys))


def over_folds(fold_metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population std of each metric over the folds that have it."""
    return fold_metrics.groupBy(*keys).agg(
        *[f(n).alias(f"{n}_{s}") for n in names
          for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def strategy_returns(predictions: DataFrame, keys: Sequence[str],
                     params: TradingParams = TradingParams(),
                     flat_on_zero: bool = False) -> DataFrame:
    """Add ``position`` (+1 long, -1 short), ``cost`` and ``net_return`` per ticker path.

    A path is the test window of one ticker in one fold, so its window is as long
    as the test window. The first position is bought from zero.
    """
    path = Window.partitionBy(*keys, "Ticker").orderBy("Date")
    short = F.lit(0.0) if flat_on_zero else F.lit(-1.0)
    out = predictions.withColumn("position", F.when(F.col("y_pred") == 1, F.lit(1.0)).otherwise(short))
    change = F.abs(F.col("position") - F.lag("position", 1, 0.0).over(path))
    out = out.withColumn("cost", change * F.lit(params.cost))
    return out.withColumn("net_return", F.col("fwd_return") * F.col("position") - F.col("cost"))


def portfolio_returns(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal-weight mean of the ticker paths, one row per day."""
    return returns.groupBy(*keys, "Date").agg(F.avg("net_return").alias("net_return"))


def equity_curve(returns: DataFrame, keys: Sequence[str], value: str = "net_return") -> DataFrame:
    """Add ``cum_return``: the compounded return up to each day."""
    w = _path(keys).orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return returns.withColumn("cum_return", F.product(F.col(value) + F.lit(1.0)).over(w) - F.lit(1.0))


def drawdown(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``drawdown`` of ``cum_return`` from its running maximum (the start is no peak)."""
    w = _path(keys).orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.max("cum_return").over(w)
    return curve.withColumn("drawdown", F.try_divide(F.col("cum_return") - peak, peak + F.lit(1.0)))


def sharpe_ratio(value: str = "net_return", params: TradingParams = TradingParams()) -> Column:
    """Yearly Sharpe ratio as an aggregate; 0 without rows or without variation.

    A std below 1e-15 times the largest return is rounding noise of a constant.
    """
    std = F.stddev_pop(value)
    noise = F.max(F.abs(F.col(value))) * F.lit(1e-15)
    excess = F.avg(value) - F.lit(params.risk_free / params.periods_per_year)
    ratio = F.sqrt(F.lit(float(params.periods_per_year))) * excess / std
    return F.when(F.count(value) == 0, 0.0).when(std <= noise, 0.0).otherwise(ratio)


def trading_metrics(returns: DataFrame, keys: Sequence[str],
                    params: TradingParams = TradingParams()) -> DataFrame:
    """Total return, Sharpe, drawdown, mean, population std and win rate per key group."""
    curve = drawdown(equity_curve(returns, keys), keys)
    return curve.groupBy(*keys).agg(
        F.max_by("cum_return", "Date").alias("total_return"),
        sharpe_ratio(params=params).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("net_return").alias("mean_return"),
        F.stddev_pop("net_return").alias("std_return"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"))


def fold_trading_metrics(predictions: DataFrame, keys: Sequence[str],
                         params: TradingParams = TradingParams()) -> DataFrame:
    """Trading metrics of the equal-weight portfolio per key group (which names the fold)."""
    paths = strategy_returns(predictions, keys, params)
    return trading_metrics(portfolio_returns(paths, keys), keys, params)


def compare(predictions: DataFrame, keys: Sequence[str] = ("variant", "model_type"),
            params: TradingParams = TradingParams(), **limits: int) -> DataFrame:
    """One row per key group: fold means and stds of all metrics."""
    by_fold = [*keys, "fold"]
    classes = over_folds(classification_metrics(predictions, by_fold, **limits), keys, CLASSIFICATION)
    trades = over_folds(fold_trading_metrics(predictions, by_fold, params), keys, TRADING)
    return classes.join(trades, list(keys))


def _path(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
