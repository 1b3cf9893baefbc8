"""Rolling time-series folds over distinct trading days.

A fold is a pair of day-index ranges, so membership is arithmetic on the index of
a day: no range join and no index arrays. Only the distinct dates of the whole
table (calendar-bounded) pass through an unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.joins import lookup_join
from signalspark.params import FoldParams
from signalspark.storage import materialize

TRAIN, TEST = "train", "test"


def _indexed_days(df: DataFrame, params: FoldParams, date: str) -> DataFrame:
    """(date, day_idx, _step, _last): distinct days, the step from fold to fold, the last fold."""
    span = params.train_days + params.test_days
    index = (F.row_number().over(Window.orderBy(date)) - 1).alias("day_idx")
    everything = Window.orderBy(date).rowsBetween(Window.unboundedPreceding,
                                                  Window.unboundedFollowing)
    days = (df.select(date).distinct()
            .select(date, index, F.count(F.lit(1)).over(everything).alias("_days")))
    enough = F.when(F.col("_days") >= span, F.col("_days")).otherwise(F.raise_error(F.concat(
        F.lit("Not enough data: "), F.col("_days").cast("string"),
        F.lit(f" days available, but need at least {span}"))).cast("long"))
    days = days.withColumn("_days", enough)
    step = F.floor((F.col("_days") - span) / F.lit(max(1, params.folds - 1)))
    days = days.withColumn("_step", F.greatest(F.lit(1), step).cast("int"))
    last = F.least(F.lit(params.folds - 1), F.floor((F.col("_days") - span) / F.col("_step"))).cast("int")
    return days.withColumn("_last", last).drop("_days")


def _folds_around(first: int, days: int) -> tuple[Column, Column]:
    """Least and greatest fold with a day among its ``days`` days from its day ``first`` on."""
    low = F.ceil((F.col("day_idx") - (first + days - 1)) / F.col("_step"))
    high = F.floor((F.col("day_idx") - first) / F.col("_step"))
    return F.greatest(F.lit(0), low).cast("int"), F.least(F.col("_last"), high).cast("int")


def fold_ranges(df: DataFrame, params: FoldParams = FoldParams(), date: str = "Date") -> DataFrame:
    """(date, day_idx, train_lo, train_hi, test_lo, test_hi): folds that train and test on each day.

    The folds of a day are a range, empty if it ends before it begins; days of no fold
    are left out.
    """
    train, test = _folds_around(0, params.train_days), _folds_around(params.train_days, params.test_days)
    names = ("train_lo", "train_hi", "test_lo", "test_hi")
    ranges = _indexed_days(df, params, date).select(date, "day_idx", *[c.alias(n) for c, n in zip((*train, *test), names)])
    return ranges.filter("train_lo <= train_hi or test_lo <= test_hi")


def fold_days(df: DataFrame, params: FoldParams = FoldParams(), date: str = "Date") -> DataFrame:
    """(fold, role, date, day_idx) for every day of every fold.

    Fold i trains on days [i*step, i*step + train) and tests on the next ``test``
    days, as long as they exist. Too few days raise an error when the table is
    computed.
    """
    span = params.train_days + params.test_days
    low, high = _folds_around(0, span)
    members = _indexed_days(df, params, date).withColumn("fold", F.explode(F.when(low <= high, F.sequence(low, high))))
    inside = F.col("day_idx") - F.col("fold") * F.col("_step")
    role = F.when(inside < params.train_days, TRAIN).otherwise(TEST)
    return members.select("fold", role.alias("role"), date, "day_idx")


def assign_folds(df: DataFrame, days: DataFrame, date: str = "Date") -> DataFrame:
    """Rows of ``df`` once per fold they belong to.

    ``days`` has at most folds * (train + test) rows, a number fixed by the
    parameters, so it is broadcast.
    """
    return df.join(F.broadcast(days.drop("day_idx")), date)


def fold_statistics(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean and population std of each feature over the training rows of each key group."""
    train = rows.filter(F.col("role") == TRAIN)
    return train.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in features],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in features])


def standardize(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Scale features by the training statistics of their group; a constant feature gives 0.

    The statistics (one row per key group) are written, and joined back by
    broadcast only if their count allows it.
    """
    stats = materialize(fold_statistics(rows, features, keys), "fold_statistics")
    scaled = {}
    for c in features:
        std = F.col(f"{c}__std")
        varies = std > F.abs(f"{c}__mean") * F.lit(1e-12)
        divisor = F.when(varies, std).otherwise(F.lit(1.0))
        scaled[c] = (F.col(c) - F.col(f"{c}__mean")) / divisor
    return (lookup_join(rows, stats, keys).withColumns(scaled)
            .drop(*[f"{c}__{s}" for c in features for s in ("mean", "std")]))
