"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up per cell (one value of every dimension). Raking rescales the
cell weights to one marginal after the other until all marginals hold. Every cell
then gets a probability, ``min(1, c * weight / tokens)``, with ``c`` calibrated so
that the expected tokens are the budget; a document is drawn when the digest of
its id and the seed falls below its cell's probability. Native throughout: cells
are a grouped table, raking is window functions over it.

A null dimension value is a category of its own, null texts have no tokens, ids
that repeat are drawn alike, and an empty table gives no rows. Where empty cells
make the marginals contradict each other, raking ends after ``max_rounds`` and
``mix_error`` tells how far the marginals are off.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.joins import lookup_join
from signalspark.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many cells are raked in one task without shuffles, more are shuffled by dimension.
ONE_TASK_CELLS = 100_000
ROUNDS_PER_WRITE = 5
#: How far each dimension is drawn from its own shares to equal shares: share ** alpha.
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SEED = "mix-1"


def n_tokens(text: str = "text") -> Column:
    """Words of a text, 0 if it is null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: str = "text") -> Column:
    """Coarse topic by plain rules, the first that holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.when(t.contains("License"), "legal").when(t.rlike("[0-9]"), "figures")
            .when(t.rlike(r"[#*$%&|<>!]"), "markup").when(F.length(t) < 1500, "short").otherwise("long"))


def cell_key(dims: Sequence[str]) -> Column:
    """One string per combination of values; null differs from every text."""
    return F.to_json(F.struct(*[F.col(d).cast("string").alias(d) for d in dims]))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], tokens: str = "tokens",
         tolerance: float = 1e-9, max_rounds: int = 100) -> DataFrame:
    """``cells`` with ``weight`` (adding up to 1) and ``mix_error``.

    A target is either the shares of a dimension's values (a value without a share
    gets none) or an exponent that flattens the shares that the table has.
    """
    cells = materialize(cells.filter(F.col(tokens) > 0), "cells")
    if cells.limit(ONE_TASK_CELLS + 1).count() <= ONE_TASK_CELLS:
        cells = cells.coalesce(1)
    cells = cells.withColumn("_all", F.lit(1))
    total = F.sum(tokens).over(Window.partitionBy("_all"))
    current = cells.withColumns({"weight": F.col(tokens) / total, "mix_error": F.lit(1.0)})
    for dim, target in targets.items():
        own = F.sum("weight").over(Window.partitionBy(dim))
        if isinstance(target, Mapping):
            share = F.coalesce(F.create_map(*[F.lit(x) for kv in target.items() for x in kv])[F.col(dim)], F.lit(0.0))
        else:
            share = F.pow("_own", F.lit(float(target)))
        current = current.withColumn("_own", own).withColumn("_share", share)
        # each value once: its cells' parts of the value's weight add up to 1
        norm = F.sum(F.col("_share") * F.col("weight") / F.col("_own")).over(Window.partitionBy("_all"))
        current = current.withColumn(f"_to_{dim}", F.col("_share") / norm).drop("_own", "_share")
    for done in range(0, max_rounds, ROUNDS_PER_WRITE):
        for _ in range(ROUNDS_PER_WRITE):
            for dim in targets:
                own = F.sum("weight").over(Window.partitionBy(dim))
                current = current.withColumn(
                    "weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_to_{dim}"), own), F.lit(0.0)))
        off = [F.abs(F.coalesce(F.try_divide(F.sum("weight").over(Window.partitionBy(d)), F.col(f"_to_{d}")), F.lit(1.0)) - 1)
               for d in targets]
        current = current.withColumn("mix_error", F.greatest(*off, F.lit(0.0)))
        current = materialize(current.withColumn("mix_error", F.max("mix_error").over(Window.partitionBy("_all"))), "raked")
        if (current.agg(F.max("mix_error")).first()[0] or 0.0) <= tolerance:
            break
        current = current.coalesce(1) if current.limit(ONE_TASK_CELLS + 1).count() <= ONE_TASK_CELLS else current
    return current.drop("_all", *[f"_to_{d}" for d in targets])


def calibrated(cells: DataFrame, budget: float, tokens: str = "tokens") -> DataFrame:
    """``cells`` with ``probability``; expected tokens are ``budget`` times all tokens, if the weights allow."""
    # cells with the largest weight per token are taken whole first; the rest shares what is left
    rate = F.col("weight") / F.col(tokens)
    cells = cells.withColumns({"_rate": rate, "_all": F.lit(1)})
    down = Window.partitionBy("_all").orderBy(F.desc("_rate"), F.desc(tokens), "_cell")
    above, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(tokens).over(Window.partitionBy("_all"))
    at = (budget * total - F.coalesce(F.sum(tokens).over(above), F.lit(0))) / F.sum("weight").over(rest)
    cells = cells.withColumns({"_c": F.when(F.col("weight") > 0, at), "_rank": F.row_number().over(down)})
    fits = F.when((F.col("_c") > 0) & (F.col("_c") * F.col("_rate") <= 1), F.col("_rank"))
    cells = cells.withColumn("_first", F.min(fits).over(Window.partitionBy("_all")))
    c = F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_c"))).over(Window.partitionBy("_all"))
    cells = cells.withColumn("_scale", c)
    # no rank fits: the budget takes every cell with a weight whole
    p = F.when(F.col("_scale").isNull(), F.when(F.col("weight") > 0, 1.0).otherwise(0.0)).otherwise(
        F.least(F.lit(1.0), F.col("_scale") * F.col("_rate")))
    return cells.withColumn("probability", F.round(p, 9)).drop(
        "_rate", "_all", "_c", "_rank", "_first", "_scale")


def draw(id_col: str = "doc_id", seed: str = SEED) -> Column:
    """Number in [0, 1) from the digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix_probabilities(slim: DataFrame, targets: Mapping[str, float | Mapping[str, float]], budget: float,
                      tokens: str = "tokens") -> DataFrame:
    """Written (_cell, weight, probability, mix_error) per cell of a table of dimensions and tokens."""
    dims = list(targets)
    cells = slim.groupBy(*dims).agg(F.sum(tokens).alias(tokens)).withColumn("_cell", cell_key(dims))
    raked = calibrated(rake(cells, targets, tokens), budget, tokens)
    return materialize(raked.select("_cell", "weight", "probability", "mix_error"), "mix")


def with_draw(df: DataFrame, cells: DataFrame, dims: Sequence[str], id_col: str = "doc_id",
              seed: str = SEED) -> DataFrame:
    """``df`` with ``weight``, ``probability``, ``mix_error`` and ``sampled``; documents without tokens are not drawn."""
    joined = lookup_join(df.withColumn("_cell", cell_key(dims)), cells, ["_cell"], "left", [id_col])
    p = F.coalesce("probability", F.lit(0.0))
    return (joined.withColumns({"probability": p, "weight": F.coalesce("weight", F.lit(0.0)),
                                "sampled": draw(id_col, seed) < p}).drop("_cell"))
