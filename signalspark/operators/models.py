"""Classifiers under rolling folds, with one predictions table as the result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.operators.boosting import BoostParams, binned, fit_boosted, predict_boosted
from signalspark.operators.fold_table import FoldTable, fold_table
from signalspark.operators.folds import TEST, TRAIN
from signalspark.operators.logistic import LOGISTIC_ITERATIONS, fit_fold_logistic, predict_logistic
from signalspark.params import FoldParams
from signalspark.storage import materialize, work_dir

# Settings of the boosted trees and the logistic regression.
TREES, DEPTH, RATE, SEED = 100, 5, 0.1, 42
PARALLEL_FITS = 10
#: Training rows of a task of a fit. A fit is thousands of small jobs, so more tasks than its rows need only cost time.
FIT_ROWS = 100_000


def boosted_trees(n_train: int = 0, **overrides) -> GBTClassifier:
    """MLlib's gradient-boosted trees on ``features`` and ``label``, for ``cv_estimator``."""
    settings = dict(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=SEED,
                    checkpointInterval=10)
    return GBTClassifier(**(settings | overrides))


def logistic_regression(n_train: int, c: float = 1.0) -> LogisticRegression:
    """L2 logistic regression of strength ``c`` on features that are already scaled."""
    return LogisticRegression(maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / (c * n_train),
                              elasticNetParam=0.0, standardization=False, tol=1e-10)


def fold_rows(df: DataFrame, features: Sequence[str], params: FoldParams = FoldParams(),
              keys: Sequence[str] = (), variant: str = "baseline") -> DataFrame:
    """Complete rows, once per fold and role, scaled per fold and assembled.

    The written table holds each row once; the copies are made where they are read.
    ``model`` is unique per variant, key and fold.
    """
    return fold_table(df, features, params, keys, variant).copies()


def predictions_of(scored: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """Rows of the predictions table."""
    return scored.select(
        "variant", F.lit(model).alias("model_type"), *keys, "Ticker", "Date",
        F.col("Target").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), "proba",
        "fwd_return")


def cv_logistic_rows(table: FoldTable, keys: Sequence[str] = ()) -> DataFrame:
    """Out-of-fold predictions of logistic regression for every model of a training table."""
    scored = predict_logistic(table.of(TEST), fit_fold_logistic(table.rows, table.scales))
    return predictions_of(scored, [*keys, "fold"], "logistic_regression")


def cv_logistic(df: DataFrame, features: Sequence[str], params: FoldParams = FoldParams(),
                keys: Sequence[str] = (), variant: str = "baseline") -> DataFrame:
    """Out-of-fold predictions of logistic regression, all folds and keys fitted together."""
    return cv_logistic_rows(fold_table(df, features, params, keys, variant), keys)


def fit_per_fold(rows: DataFrame, make_estimator: Callable[[int], Estimator],
                 parallel: int = PARALLEL_FITS) -> dict[str, Model]:
    """One MLlib model per ``model`` id of the training rows.

    The models are independent jobs submitted from a few driver threads, as
    MLlib's own cross-validator does; each fit is distributed over its rows,
    ``FIT_ROWS`` in a task, however many files the source tables came in.
    Boosting cuts its lineage every few trees in the shared checkpoint folder.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(rows.sparkSession))
    train = rows.filter(F.col("role") == TRAIN)
    sizes = {r["model"]: r["count"] for r in train.groupBy("model").count().collect()}
    # written, as every fit reads it
    train = materialize(train.select("model", F.col("y").alias("label"), "x"), "fold_rows")
    vectors = train.select("model", "label", array_to_vector("x").alias("features"))

    def fit(model: str) -> tuple[str, Model]:
        mine = vectors.filter(F.col("model") == model).drop("model").coalesce(fit_tasks(sizes[model]))
        return model, make_estimator(sizes[model]).fit(mine)

    with ThreadPool(min(parallel, max(1, len(sizes)))) as pool:
        return dict(pool.map(fit, sorted(sizes)))


def fit_tasks(rows: int) -> int:
    """Tasks of each job of a fit over so many rows."""
    return max(1, -(-rows // FIT_ROWS))


def predict_per_fold(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Test rows with the prediction of their own fold's model."""
    test = rows.filter(F.col("role") == TEST).withColumn("features", array_to_vector("x"))
    parts = [m.transform(test.filter(F.col("model") == name))
             .withColumn("proba", vector_to_array("probability")[1])
             .withColumn("y_pred", F.col("prediction").cast("int"))
             .drop("features", "rawPrediction", "probability", "prediction")
             for name, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def cv_estimator_rows(table: FoldTable | DataFrame, make_estimator: Callable[[int], Estimator], model: str,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Out-of-fold predictions of an MLlib classifier for every model of a training table or of its ``fold_rows``."""
    rows = table.copies() if isinstance(table, FoldTable) else table
    scored = predict_per_fold(rows, fit_per_fold(rows, make_estimator))
    return predictions_of(scored, [*keys, "fold"], model)


def cv_estimator(df: DataFrame, features: Sequence[str], make_estimator: Callable[[int], Estimator],
                 params: FoldParams = FoldParams(), keys: Sequence[str] = (),
                 variant: str = "baseline", model: str = "custom") -> DataFrame:
    """Out-of-fold predictions of any MLlib classifier (``make_estimator(n_train)``)."""
    return cv_estimator_rows(fold_rows(df, features, params, keys, variant), make_estimator,
                             model, keys)


def cv_boosted_rows(table: FoldTable, keys: Sequence[str] = (), params: BoostParams = BoostParams()) -> DataFrame:
    """Out-of-fold predictions of gradient-boosted trees, all models of a training table grown together."""
    rows = binned(table)
    scored = predict_boosted(table, fit_boosted(table, params, rows=rows), rows)
    return predictions_of(scored, [*keys, "fold"], "boosted_trees")


def cv_boosted(df: DataFrame, features: Sequence[str], params: FoldParams = FoldParams(),
               keys: Sequence[str] = (), variant: str = "baseline", **overrides) -> DataFrame:
    """Out-of-fold predictions of gradient-boosted trees; ``overrides`` are fields of ``BoostParams``."""
    return cv_boosted_rows(fold_table(df, features, params, keys, variant), keys, BoostParams(**overrides))


#: Models by name: training table and keys to out-of-fold predictions.
MODELS: dict[str, Callable[..., DataFrame]] = {"logistic_regression": cv_logistic_rows, "boosted_trees": cv_boosted_rows}


def coefficient_importance(coefficients: DataFrame, features: Sequence[str]) -> DataFrame:
    """(model, feature, importance = |coefficient|) of fitted logistic models."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("coef"))).alias("pair")
    return (coefficients.select("model", pairs)
            .select("model", F.col("pair.feature").alias("feature"),
                    F.abs("pair.coef").alias("importance")))


def tree_importance(spark: SparkSession, models: dict[str, Model],
                    features: Sequence[str]) -> DataFrame:
    """(model, feature, importance) of fitted tree models."""
    rows = [(name, f, float(v)) for name, m in models.items()
            for f, v in zip(features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")
