"""Training tables of rolling folds that hold every row once.

A row carries the range of folds that train on it and the range that test on it, so
nothing is copied per fold. What differs per fold is small: the mean and spread
of the features. They come from moments per day: running sums over the days of a
group give those of any fold as the difference of two of them. The copies exist only
where a row is read, in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.features import model_matrix
from signalspark.operators.folds import TEST, TRAIN, fold_ranges
from signalspark.operators.joins import lookup_join
from signalspark.operators.logistic import assemble
from signalspark.params import FoldParams
from signalspark.storage import materialize

RANGES = {TRAIN: ("train_lo", "train_hi"), TEST: ("test_lo", "test_hi")}


@dataclass(frozen=True)
class FoldTable:
    """Rows, once per ``group`` (variant and keys), and the scale of each fold.

    ``rows``: variant, keys, group, Ticker, Date, Target, fwd_return, x (features as they
    are), y, day_idx and the fold ranges. ``scales``: group, fold, model, n_train, center,
    divisor; one row per model.
    """

    rows: DataFrame
    scales: DataFrame

    def of(self, role: str, scaled: bool = True) -> DataFrame:
        """Rows of one role, once per fold, with ``fold``, ``role``, ``model``; ``x`` scaled by the fold's training days."""
        low, high = (F.col(c) for c in RANGES[role])
        bounds = [c for pair in RANGES.values() for c in pair]
        each = (self.rows.filter(low <= high).withColumn("fold", F.explode(F.sequence(low, high)))
                .withColumn("role", F.lit(role)).drop(*bounds))
        known = lookup_join(each, self.scales.drop("n_train"), ["group", "fold"], salt_by=["Ticker", "Date"])
        unit = F.transform(F.arrays_zip("x", "center", "divisor"), lambda e: (e["x"] - e["center"]) / e["divisor"])
        return known.withColumn("x", unit if scaled else F.col("x")).drop("center", "divisor", "group", "day_idx")

    def copies(self) -> DataFrame:
        """Rows of both roles, once per fold."""
        return self.of(TRAIN).unionByName(self.of(TEST))


def fold_table(df: DataFrame, features: Sequence[str], params: FoldParams = FoldParams(),
               keys: Sequence[str] = (), variant: str = "baseline") -> FoldTable:
    """Written training table of the complete rows of ``df``."""
    kept = [*keys, "Ticker", "Date", "Target", "fwd_return", *features]
    matrix = materialize(model_matrix(df, features).select(*kept), "matrix")
    # one row per calendar day of the folds
    placed = matrix.join(F.broadcast(fold_ranges(matrix, params)), "Date").withColumn("variant", F.lit(variant))
    rows = assemble(placed, features, ["variant", *keys]).withColumnRenamed("model", "group")
    # ranges of (group, day): a pass then sends few partial sums per model, and a large group is still many tasks.
    # The number is given, as a pass has more work per byte than adaptive execution would merge partitions for
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(rows.repartitionByRange(parts, "group", "day_idx").sortWithinPartitions("group", "day_idx"), "fold_table")
    return FoldTable(table, materialize(fold_scales(table), "fold_scales"))


def united(tables: Sequence[FoldTable]) -> FoldTable:
    """The models of several tables side by side."""
    return FoldTable(*(reduce(DataFrame.unionByName, [getattr(t, part) for t in tables]) for part in ("rows", "scales")))


PIECES = ("group string, day_idx int, train_lo int, train_hi int, n bigint, "
          "moments array<struct<mean:double,squares:double>>")


def day_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper: count, mean and squared deviations of each feature per group and day of a batch."""
    for batch in batches:
        coded = batch.column("group").dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        day, low, high = (batch.column(c).to_numpy() for c in ("day_idx", "train_lo", "train_hi"))
        for code, group in enumerate(coded.dictionary.to_pylist()):
            mine = np.flatnonzero(codes == code)
            mine = mine[np.argsort(day[mine], kind="stable")]
            x = batch.column("x").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
            _, first = np.unique(day[mine], return_index=True)
            n = np.diff(np.append(first, len(mine)))
            mean = np.add.reduceat(x, first) / n[:, None]
            squares = np.add.reduceat((x - np.repeat(mean, n, axis=0)) ** 2, first)
            at = mine[first]
            pairs = pa.StructArray.from_arrays([pa.array(mean.ravel()), pa.array(squares.ravel())], ["mean", "squares"])
            moments = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(n), pa.string()), *[pa.array(v[at], pa.int32()) for v in (day, low, high)], pa.array(n, pa.int64()),
                 moments], names=["group", "day_idx", "train_lo", "train_hi", "n", "moments"])


def fold_scales(rows: DataFrame) -> DataFrame:
    """(group, fold, model, n_train, center, divisor) of every fold's training days.

    Moments of days, in one piece or several, are added along the days as deviations from
    the mean of the whole group, so that differences of the running sums keep their
    digits. A constant feature has divisor 1.
    """
    days = ["group", "day_idx", "train_lo", "train_hi"]
    daily = (rows.filter("train_lo <= train_hi").select(*days, "x").mapInArrow(day_moments, PIECES)
             .select(*days, "n", F.posexplode("moments").alias("pos", "_m")).select(*days, "n", "pos", "_m.*"))
    whole = Window.partitionBy("group", "pos")
    along = whole.orderBy("day_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, off = F.col("n"), F.col("mean") - F.col("shift")
    shift = F.sum(n * F.col("mean")).over(whole) / F.sum(n).over(whole)
    sums = daily.withColumn("shift", shift).select(
        *days, "pos", "shift", F.sum(n).over(along).alias("n"), F.sum(n * off).over(along).alias("s1"),
        F.sum(F.col("squares") + n * off * off).over(along).alias("s2"))
    mean = F.col("s1") / F.col("n")
    center = F.col("shift") + mean
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    divisor = F.when(spread > F.abs(center) * F.lit(1e-12), spread).otherwise(F.lit(1.0))
    each = _differences(sums).select("group", "fold", "n", F.struct("pos", center.alias("center"), divisor.alias("divisor")).alias("e"))
    return (each.groupBy("group", "fold").agg(F.first("n").alias("n_train"), F.array_sort(F.collect_list("e")).alias("e"))
            .select("group", "fold", F.concat_ws("|", "group", F.col("fold").cast("string")).alias("model"), "n_train",
                    F.col("e.center").alias("center"), F.col("e.divisor").alias("divisor")))


def _differences(sums: DataFrame) -> DataFrame:
    """Sums over the training days of each fold, from running sums over the days that a group has.

    Folds go on by the day, so the last day of a fold is the last one that names it, and
    the days before the fold are those before the first one that names it.
    """
    order = Window.partitionBy("group", "pos").orderBy("day_idx")
    names = ("n", "s1", "s2")
    folds = F.sequence("train_lo", "train_hi")
    opened = F.coalesce(F.lag("train_hi").over(order), F.lit(-1))
    closed = F.coalesce(F.lead("train_lo").over(order), F.lit(2**31 - 1))
    edges = sums.select("*", *[F.coalesce(F.lag(c).over(order), F.lit(0)).alias(f"_{c}") for c in names],
                        opened.alias("_opened"), closed.alias("_closed"))
    # each row ends the folds that the next one does not name, and begins those that the one before does not
    change = lambda sign, before: lambda f: F.struct(
        f.alias("fold"), *[(sign * F.col(before + c)).alias(c) for c in names])
    ends = F.transform(F.filter(folds, lambda f: f < F.col("_closed")), change(1, ""))
    starts = F.transform(F.filter(folds, lambda f: f > F.col("_opened")), change(-1, "_"))
    changes = edges.select("group", "pos", "shift", F.inline(F.concat(ends, starts)))
    return changes.groupBy("group", "pos", "fold", "shift").agg(*[F.sum(c).alias(c) for c in names])
