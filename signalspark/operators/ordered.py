"""Order statistics of groups that may be too large for one task.

Quantiles and AUC need the running total of everything below a value. Equal
values are added up first, so a value that fills a third of the table is one row.
If what remains is small enough (counted, not assumed) one window per group does
the rest. Otherwise each group is cut into value ranges of similar depth at
approximate quantiles; the ranges are only a way to split the work, the running
totals are exact whatever the cuts are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.joins import lookup_join
from signalspark.storage import materialize

# Distinct values of one group that a single window task may sort.
MAX_GROUP_ROWS = 2_000_000
RANGES = 128


def running_totals(df: DataFrame, group: Sequence[str], value: str,
                   amounts: Mapping[str, Column], unique: bool = False,
                   max_group_rows: int = MAX_GROUP_ROWS, ranges: int = RANGES) -> DataFrame:
    """One row per group and distinct value with the amounts of that value,
    ``{name}_before`` (all smaller values) and ``{name}_total`` (whole group).

    ``unique`` says that ``df`` is a written table that has each value of a group
    in one row already.
    """
    group = list(group)
    if unique:
        distinct = df.select(*group, value, *[a.alias(n) for n, a in amounts.items()])
    else:
        distinct = materialize(
            df.filter(F.col(value).isNotNull()).groupBy(*group, value)
            .agg(*[F.sum(a).alias(n) for n, a in amounts.items()]), "distinct_values")
    largest = distinct.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= max_group_rows:
        return _within(distinct, group, value, amounts)
    cuts = [i / ranges for i in range(1, ranges)]
    edges = materialize(distinct.groupBy(*group).agg(
        F.percentile_approx(value, F.array(*[F.lit(c) for c in cuts]), F.lit(20 * ranges))
        .alias("_edges")), "edges")
    cut = lookup_join(distinct, edges, group, "inner", [value])
    cut = cut.withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    sums = cut.groupBy(*group, "_range").agg(*[F.sum(n).alias(n) for n in amounts])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = materialize(sums.select(
        *group, "_range",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in amounts],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in amounts]), "offsets")
    inner = _within(cut, [*group, "_range"], value, amounts).drop(*[f"{n}_total" for n in amounts])
    joined = lookup_join(inner, offsets, [*group, "_range"], "inner", [value])
    return joined.select(*group, value, *amounts,
                         *[(F.col(f"{n}_before") + F.col(f"_{n}_offset")).alias(f"{n}_before")
                           for n in amounts], *[f"{n}_total" for n in amounts])


def _within(df: DataFrame, group: Sequence[str], value: str,
            amounts: Mapping[str, Column]) -> DataFrame:
    """Running totals by one window per group (or per range of a group)."""
    if not group:
        df, group = df.withColumn("_all", F.lit(1)), ["_all"]
    below = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return df.withColumns(
        {f"{n}_before": F.coalesce(F.sum(n).over(below), F.lit(0)) for n in amounts}
        | {f"{n}_total": F.sum(n).over(whole) for n in amounts}).drop("_all")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float],
                    count: Column | None = None, **limits: int) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per name in ``probs``.

    With ``count``, ``df`` is a written table of distinct values and their counts.
    """
    ranked = running_totals(df, group, value, {"_n": F.lit(1) if count is None else count},
                            unique=count is not None, **limits)
    sides = {}
    for name, p in probs.items():
        at = (F.col("_n_total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))
            sides[f"_{name}_{side}"] = F.max(F.when(here, F.col(value)))
        sides[f"_{name}_part"] = F.max(at - F.floor(at))
    found = ranked.groupBy(*group).agg(*[c.alias(n) for n, c in sides.items()])
    return found.select(*group, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
        for n in probs])


def auc(df: DataFrame, group: Sequence[str], truth: str = "y_true", proba: str = "proba",
        **limits: int) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; 0.5 if a class is missing."""
    amounts = {"_pos": F.when(F.col(truth) == 1, 1).otherwise(0),
               "_neg": F.when(F.col(truth) == 1, 0).otherwise(1)}
    ranked = running_totals(df, group, proba, amounts, **limits)
    wins = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") * F.lit(0.5)))
    pairs = F.max(F.col("_pos_total").cast("double") * F.col("_neg_total"))
    return ranked.groupBy(*group).agg(
        F.coalesce(F.try_divide(wins, pairs), F.lit(0.5)).alias("auc"))
