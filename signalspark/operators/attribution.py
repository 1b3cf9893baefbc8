"""How much each feature moves a model's output."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """The ``n`` rows whose hashed key comes first: random, repeatable, a per-task top-n."""
    return df.orderBy(_draw(key, seed), *key).limit(n)


def sample_per_group(df: DataFrame, groups: Sequence[str], n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``sample_rows`` of every group at once.

    Each task keeps the ``n`` first rows of a group before the shuffle, so a group of any size
    sends ``n`` rows per task.
    """
    order = Window.partitionBy(*groups).orderBy(_draw(key, seed), *key)
    return df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_place")


def _draw(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def mean_absolute(contributions: DataFrame, features: Sequence[str],
                  keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute value per feature column, as rows (keys..., feature, importance)."""
    means = contributions.groupBy(*keys).agg(*[F.avg(F.abs(c)).alias(c) for c in features])
    return means.unpivot(list(keys), list(features), "feature", "importance")


def linear_contributions(rows: DataFrame, coefficients: dict[str, Column],
                         centers: dict[str, Column]) -> DataFrame:
    """Exact attribution of a linear model: coefficient times distance from the mean."""
    return rows.withColumns({f: c * (F.col(f) - centers[f]) for f, c in coefficients.items()})


def fitted_attribution(rows: DataFrame, coefficients: DataFrame,
                       features: Sequence[str]) -> DataFrame:
    """(model, feature, importance) of fitted logistic models over scaled rows ``model, x``.

    The features are scaled by their training mean, so coefficient times value is
    the exact attribution. One coefficient row per model is broadcast.
    """
    terms = F.zip_with("x", "coef", lambda x, c: F.abs(x * c))
    parts = (rows.select("model", "x").join(F.broadcast(coefficients.select("model", "coef")), "model")
             .select("model", F.posexplode(terms).alias("_pos", "_term")))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_pos") + 1)
    return (parts.groupBy("model", "_pos").agg(F.avg("_term").alias("importance"))
            .select("model", name.alias("feature"), "importance"))


def sampled_shapley(model: Model, explain: DataFrame, background: DataFrame,
                    features: Sequence[str], permutations: int = 10, seed: int = 42) -> DataFrame:
    """Monte-Carlo Shapley values (Strumbelj and Kononenko) of any MLlib classifier.

    ``explain`` and ``background`` hold an array ``x``. For each explained row and
    each random feature order, the row's values replace a background row's values
    one by one; the change of the margin at each replacement is credited to that
    feature. The model scores all mixed rows in one ``transform``.
    """
    d = len(features)
    rng = random.Random(seed)
    orders = [rng.sample(range(d), d) for _ in range(permutations)]
    # rank of feature i in each order: it is replaced from that step on
    ranks = F.array(*[F.array(*[F.lit(o.index(i)) for i in range(d)]) for o in orders])
    order = Window.orderBy("_mixed")
    mixed = F.xxhash64(F.col("x"), F.lit(seed)).alias("_mixed")
    here = explain.select("x", mixed).withColumn("_row", F.row_number().over(order) - 1)
    base = background.select(F.col("x").alias("b"), mixed_of(background, seed))
    base = base.withColumn("_slot", F.row_number().over(order) - 1).drop("_mixed")
    count = base.count()
    drawn = (here.select("x", "_row", F.posexplode(ranks).alias("_order", "_rank"))
             .withColumn("_slot", F.pmod(F.col("_row") * permutations + F.col("_order"), F.lit(count)))
             .join(base, "_slot"))
    steps = drawn.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    blended = F.transform(
        F.arrays_zip("x", "b", "_rank"),
        lambda e: F.when(e["_rank"] < F.col("_step"), e["x"]).otherwise(e["b"]))
    scored = model.transform(steps.withColumn("features", array_to_vector(blended)))
    margin = vector_to_array("rawPrediction")[1]
    walk = Window.partitionBy("_row", "_order").orderBy("_step")
    change = scored.select("_row", "_order", "_step", "_rank", margin.alias("m"))
    change = change.withColumn("phi", F.col("m") - F.lag("m").over(walk)).filter(F.col("_step") > 0)
    moved = F.array_position("_rank", F.col("_step") - 1).cast("int")
    names = F.array(*[F.lit(f) for f in features])
    per_row = (change.withColumn("feature", F.element_at(names, moved))
               .groupBy("_row", "feature").agg(F.avg("phi").alias("phi")))
    return per_row.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def mixed_of(df: DataFrame, seed: int) -> Column:
    """Repeatable pseudo-random order of rows by their features."""
    return F.xxhash64(F.col("x"), F.lit(seed)).alias("_mixed")


def compare_importance(baseline: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Importance of both models side by side, 0 where a model lacks the feature; NaN stays NaN."""
    left = baseline.select("feature", F.col("importance").alias("baseline_importance"))
    right = sentiment.select("feature", F.col("importance").alias("sentiment_importance"))
    both = left.join(right, "feature", "full").withColumns({
        c: F.coalesce(c, F.lit(0.0)) for c in ("baseline_importance", "sentiment_importance")})
    change = F.col("sentiment_importance") - F.col("baseline_importance")
    return (both.withColumn("importance_change", change)
            .orderBy(F.desc("sentiment_importance"), "feature"))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most important features."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
