"""Many L2 logistic regressions fitted together.

A cross-validated sweep needs hundreds of small models on overlapping rows.
Fitting them one by one is hundreds of job chains; collecting each training set
into one task breaks when it grows. Here one Newton step of *all* models is one
pass over the training table: each partition adds up gradient and curvature of
the models it holds rows of, the partial sums are added per model, and the new
coefficients (models x features, fixed by the parameters) go back with the next
pass. No training set is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


PARTIAL = "model string, part int, n bigint, stats array<double>"
STATE = "model string, n bigint, beta array<double>, previous array<double>, loss double, done boolean"
#: Models in a batch that are not finished: id, features and labels of their rows.
Models = Callable[[pa.RecordBatch, frozenset[str]], Iterator[tuple[str, np.ndarray, np.ndarray]]]
# Partial rows of one model that one task adds up; each holds the square of the features.
FAN_IN = 256
# Fixed value: most steps of a fit. Newton steps converge in some ten; ``converged`` tells if one did not.
LOGISTIC_ITERATIONS = 1000


def assemble(rows: DataFrame, features: Sequence[str], keys: Sequence[str],
             label: str = "Target") -> DataFrame:
    """``model`` (text id of the keys), ``x`` (features as array), ``y`` and all other columns."""
    # escaped, so that different keys never give one id; null differs from every text
    plain = [F.replace(F.replace(F.col(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for k in keys]
    parts = [F.coalesce(p, F.lit("\\N")) for p in plain]
    return rows.withColumns({
        "model": F.concat_ws("|", *parts),
        "x": F.array(*[F.col(c).cast("double") for c in features]),
        "y": F.col(label).cast("double")}).drop(*[f for f in features if f not in ("model", "x", "y")])


def fit_logistic(train: DataFrame, c: float = 1.0, max_iter: int = LOGISTIC_ITERATIONS, tol: float = 1e-9,
                 fan_in: int = FAN_IN) -> DataFrame:
    """Coefficients ``(model, intercept, coef, n_train, converged, iterations)`` of every model in ``train``.

    Minimises ``c * sum(log loss) + |coef|^2 / 2``; the intercept is not
    penalised. ``train`` holds ``model, x, y`` and is read once per step, so pass
    a written table. With more than ``fan_in`` partitions the partial sums are
    added in two levels.
    """
    return _newton(train.select("model", "x", "y"), _batch_models, c, max_iter, tol, fan_in)


def fit_fold_logistic(rows: DataFrame, scales: DataFrame, c: float = 1.0, max_iter: int = LOGISTIC_ITERATIONS,
                      tol: float = 1e-9, fan_in: int = FAN_IN) -> DataFrame:
    """``fit_logistic`` over rows that hold a range of folds, read once for all of them.

    ``rows``: ``group, x, y, train_lo, train_hi``; ``scales``: ``group, fold, model, center,
    divisor``, one row per model, which go to the tasks as the coefficients do.
    """
    known: dict[str, list[tuple[int, str, np.ndarray, np.ndarray]]] = {}
    for r in scales.select("group", "fold", "model", "center", "divisor").collect():
        known.setdefault(r.group, []).append((r.fold, r.model, np.asarray(r.center), np.asarray(r.divisor)))
    given = rows.sparkSession.sparkContext.broadcast(known)

    def models(batch: pa.RecordBatch, finished: frozenset[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        low, high = (batch.column(c).to_numpy() for c in ("train_lo", "train_hi"))
        for group, mine in _groups(batch, "group"):
            values = _matrix(batch, mine)
            for fold, model, center, divisor in given.value.get(group, ()):
                inside = (low[mine] <= fold) & (fold <= high[mine])
                if model not in finished and inside.any():
                    yield model, (values[inside] - center) / divisor, y[mine][inside]

    train = rows.filter("train_lo <= train_hi").select("group", "x", "y", "train_lo", "train_hi")
    return _newton(train, models, c, max_iter, tol, fan_in)


def _newton(rows: DataFrame, models: Models, c: float, max_iter: int, tol: float, fan_in: int) -> DataFrame:
    """Newton steps of all models that ``models`` finds in the batches of ``rows``."""
    wide = rows.rdd.getNumPartitions() > fan_in
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states: dict[str, Row] = {}
    steps: dict[str, int] = {}
    for _ in range(max_iter):
        sums = rows.mapInArrow(_partial_sums(states, fan_in, models), PARTIAL)
        if wide:
            sums = sums.groupBy("model", "part").applyInPandas(_add_up, PARTIAL)
        # the number is given: a step is much work for few bytes
        dealt = sums.repartition(parts, "model").sortWithinPartitions("model")
        stepped = dealt.mapInArrow(_newton_step(states, c, tol), STATE).collect()
        states |= {r.model: r for r in stepped}
        steps |= {r.model: steps.get(r.model, 0) + 1 for r in stepped}
        if all(r.done for r in states.values()):
            break
    return rows.sparkSession.createDataFrame(
        [(r.model, r.beta[-1], r.beta[:-1], r.n, r.done, steps[r.model]) for r in states.values()],
        "model string, intercept double, coef array<double>, n_train bigint, converged boolean, iterations int")


def predict_logistic(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Add ``proba`` and ``y_pred``; the dot product stays in the JVM.

    The coefficient table has one row per model, so it is broadcast.
    """
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = rows.join(F.broadcast(coefficients.select("model", "intercept", "coef")), "model")
    scored = scored.withColumn("_z", dot + F.col("intercept"))
    return scored.withColumns({
        "proba": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))),
        "y_pred": (F.col("_z") > 0).cast("int")}).drop("_z", "coef", "intercept")


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, np.ndarray]]:
    """Values of a text column, each with the places of its rows."""
    coded = batch.column(column).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for code, value in enumerate(coded.dictionary.to_pylist()):
        yield value, np.flatnonzero(codes == code)


def _matrix(batch: pa.RecordBatch, places: np.ndarray) -> np.ndarray:
    """Features of some rows; groups may differ in their number of features, rows of one group do not."""
    values = batch.column("x").take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(places), -1)


def _batch_models(batch: pa.RecordBatch, finished: frozenset[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    y = batch.column("y").to_numpy(zero_copy_only=False)
    for model, mine in _groups(batch, "model"):
        if model not in finished:
            yield model, _matrix(batch, mine), y[mine]


def _partial_sums(states: dict[str, Row], fan_in: int, models: Models):
    """Arrow mapper: one row of sums per unfinished model present in the partition."""
    betas = {m: np.asarray(r.beta) for m, r in states.items() if not r.done}
    finished = frozenset(m for m, r in states.items() if r.done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for model, values, y in models(batch, finished):
                design = np.column_stack([values, np.ones(len(values))])
                stats = _loss_sums(design, y, betas.get(model))
                totals[model] = totals[model] + stats if model in totals else stats
                counts[model] = counts.get(model, 0) + design.shape[0]
        if totals:
            names = list(totals)
            part = TaskContext.get().partitionId() % fan_in
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([part] * len(names), pa.int32()),
                 pa.array([counts[m] for m in names], pa.int64()),
                 pa.array([totals[m] for m in names], pa.list_(pa.float64()))],
                names=["model", "part", "n", "stats"])

    return run


def _add_up(parts: pd.DataFrame) -> pd.DataFrame:
    """First level of the sum: the partial rows of one model from some of the partitions."""
    stats = np.sum(np.vstack(parts["stats"].to_numpy()), axis=0)
    return pd.DataFrame({"model": [parts["model"].iloc[0]], "part": [int(parts["part"].iloc[0])],
                         "n": [int(parts["n"].sum())], "stats": [stats]})


def _loss_sums(design: np.ndarray, y: np.ndarray, beta: np.ndarray | None) -> np.ndarray:
    """Log loss, its gradient and its curvature over some rows, as one vector."""
    z = design @ (np.zeros(design.shape[1]) if beta is None else beta)
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    curvature = (design * (p * (1.0 - p))[:, None]).T @ design
    loss = np.sum(np.logaddexp(0.0, z) - y * z)
    return np.concatenate([[loss], design.T @ (p - y), curvature.ravel()])


def _newton_step(states: dict[str, Row], c: float, tol: float):
    """Arrow mapper over partial sums that are sorted by model: new coefficients of each model."""
    known = {m: (np.asarray(r.beta), np.asarray(r.previous), r.loss) for m, r in states.items()}

    def step(model: str, n: int, stats: np.ndarray) -> dict:
        d = int(round((np.sqrt(4 * stats.size - 3) - 1) / 2))
        beta, previous, best = known.get(model, (np.zeros(d), np.zeros(d), np.inf))
        penalty = np.append(np.ones(d - 1), 0.0)
        loss = c * stats[0] + 0.5 * np.sum(penalty * beta * beta)
        if loss > best * (1 + 1e-12) + 1e-12:
            # the last step went too far: go back half of it
            new, previous, loss, done = (beta + previous) / 2, previous, best, False
        else:
            gradient = c * stats[1:1 + d] + penalty * beta
            curvature = c * stats[1 + d:].reshape(d, d) + np.diag(penalty)
            move = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            new, previous, done = beta - move, beta, bool(np.max(np.abs(move)) < tol)
        return {"model": model, "n": n, "beta": new.tolist(), "previous": previous.tolist(), "loss": float(loss), "done": done}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("model", pa.string()), ("n", pa.int64()), ("beta", pa.list_(pa.float64())),
                            ("previous", pa.list_(pa.float64())), ("loss", pa.float64()), ("done", pa.bool_())])
        model, n, total = None, 0, None
        for batch in batches:
            counts, stats = batch.column("n").to_pylist(), batch.column("stats")
            for k, name in enumerate(batch.column("model").to_pylist()):
                part = stats[k].values.to_numpy(zero_copy_only=False)
                if name == model:
                    n, total = n + counts[k], total + part
                    continue
                if model is not None:
                    yield pa.RecordBatch.from_pylist([step(model, n, total)], schema)
                model, n, total = name, counts[k], part
        if model is not None:
            yield pa.RecordBatch.from_pylist([step(model, n, total)], schema)

    return run
