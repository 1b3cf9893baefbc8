"""Text scoring: any batch model, run once per distinct text.

A model is a ``make_predict_fn`` as ``predict_batch_udf`` wants it: called once
per Python worker, it loads the model and returns a function from a batch of
texts to an array of class probabilities, columns ordered as ``labels`` says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalspark.functions.text import (
    NEGATIVE, NEUTRAL, POSITIVE, combined_text, lexicon_shares, score_from_probs, text_key)
from signalspark.operators.joins import lookup_join
from signalspark.storage import materialize, small_batches

# Class columns of scored text, and texts per model call.
CLASSES = (NEGATIVE, NEUTRAL, POSITIVE)
BATCH_SIZE = 64
#: Characters of a batch with its padding, about those of 64 texts of some hundred words.
PADDED_CHARS = 1 << 18


def with_score(df: DataFrame) -> DataFrame:
    """Add ``sentiment_score`` from the class columns."""
    return df.withColumn("sentiment_score", score_from_probs(POSITIVE, NEGATIVE))


def with_text(news: DataFrame) -> DataFrame:
    """Add ``combined_text`` (headline and description, cleaned) and its ``text_key``."""
    out = news.withColumn("combined_text", combined_text("Headlines", "Description"))
    return out.withColumn("text_key", text_key("combined_text"))


def score_lexicon(df: DataFrame, text: str, positive: Sequence[str],
                  negative: Sequence[str]) -> DataFrame:
    """Class shares by word lists: a projection, no Python and no shuffle."""
    shares = df.withColumn("_shares", lexicon_shares(text, positive, negative))
    return with_score(shares.withColumns({c: F.col(f"_shares.{c}") for c in CLASSES}).drop("_shares"))


def distinct_texts(news: DataFrame, text: str = "combined_text", key: str = "text_key") -> DataFrame:
    """One row per text; copies are reduced inside the map tasks."""
    return news.groupBy(key).agg(F.first(text).alias(text))


def score_distinct(texts: DataFrame, make_predict_fn: Callable, labels: Sequence[str] = CLASSES,
                   text: str = "combined_text", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Class columns of each text. Probabilities are bound to classes by label name."""
    if sorted(labels) != sorted(CLASSES):
        raise ValueError(f"Model labels {list(labels)} are not {list(CLASSES)}")
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in labels])
    predict = predict_batch_udf(_named(make_predict_fn, tuple(labels)), return_type=schema,
                                batch_size=batch_size)
    scored = texts.withColumn("_probs", predict(F.col(text)))
    return with_score(scored.withColumns({c: F.col(f"_probs.{c}") for c in CLASSES}).drop("_probs"))


def budget_batches(lengths: np.ndarray, budget: int) -> list[slice]:
    """Runs of ascending lengths whose padded size (longest times number) is within ``budget``.

    A text longer than the budget is a batch of its own.
    """
    out, start = [], 0
    for k, length in enumerate(lengths.tolist()):
        # lengths ascend, so the one at hand is the longest of the run
        if k > start and max(1, length) * (k - start + 1) > budget:
            out.append(slice(start, k))
            start = k
    return [*out, slice(start, len(lengths))] if len(lengths) else out


def by_length(texts: DataFrame, text: str = "combined_text") -> DataFrame:
    """Texts of each partition by length; a partition of distinct texts has all lengths, so none is slow."""
    return texts.withColumn("_length", F.length(text)).sortWithinPartitions("_length")


def score_budgeted(texts: DataFrame, make_predict_fn: Callable, labels: Sequence[str] = CLASSES,
                   text: str = "combined_text", budget: int = PADDED_CHARS) -> DataFrame:
    """``score_distinct`` in batches of a bounded padded size instead of a fixed number of texts.

    Texts of like length share a batch, so little of it is padding; a very long text is
    a batch of its own and holds up no other.
    """
    if sorted(labels) != sorted(CLASSES):
        raise ValueError(f"Model labels {list(labels)} are not {list(CLASSES)}")
    kept = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict_fn()
        for batch in batches:
            lengths = batch.column("_length").to_numpy(zero_copy_only=False)
            # only the texts of one call are Python strings
            parts = [np.asarray(predict(np.array(batch.column(text)[part].to_pylist(), object)), float)
                     for part in budget_batches(np.nan_to_num(lengths), budget)]
            if parts:
                found = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(found[:, i]) for i in range(len(labels))]],
                                                 names=[*kept, *labels])

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema], *[f"{c} double" for c in labels]])
    return with_score(by_length(texts, text).mapInArrow(run, kinds))


def padding_share(texts: DataFrame, text: str = "combined_text", budget: int = PADDED_CHARS,
                  batch_size: int = BATCH_SIZE) -> DataFrame:
    """One row: share of padding in all batches, by budget and by number (``batch_size`` texts as they come)."""
    def sizes(batches: Iterator[pa.RecordBatch], count: int | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.nan_to_num(batch.column("_length").to_numpy(zero_copy_only=False)).astype(np.int64)
            parts = budget_batches(n, budget) if count is None else [slice(k, k + count) for k in range(0, len(n), count)]
            padded = sum(int(n[p].max()) * len(n[p]) for p in parts)
            yield pa.RecordBatch.from_arrays([pa.array([padded]), pa.array([int(n.sum())])], names=["padded", "used"])

    share = 1 - F.sum("used") / F.sum("padded")
    plain = texts.withColumn("_length", F.length(text))
    one = by_length(texts, text).select("_length").mapInArrow(sizes, "padded long, used long").agg(share.alias("by_budget"))
    other = plain.select("_length").mapInArrow(lambda b: sizes(b, batch_size), "padded long, used long").agg(share.alias("by_number"))
    return one.withColumn("_", F.lit(0)).join(other.withColumn("_", F.lit(0)), "_").drop("_")  # a row each


def score_texts(news: DataFrame, make_predict_fn: Callable, labels: Sequence[str] = CLASSES,
                batch_size: int = BATCH_SIZE, salt_by: Sequence[str] = ("Time", "Headlines"),
                budget: int | None = None, **join_limits: float) -> DataFrame:
    """News with class columns and score; each distinct text is scored once.

    With ``budget`` batches have a bounded padded size instead of ``batch_size`` texts.

    The scores are written before the join, so a lost executor does not run the
    model again; Python gets ``TEXT_ROWS`` texts at once. A text copied a million
    times joins through a salted key.
    """
    texted = with_text(news)
    if budget is None:
        scored = score_distinct(distinct_texts(texted), make_predict_fn, labels, batch_size=batch_size)
    else:
        scored = score_budgeted(distinct_texts(texted), make_predict_fn, labels, budget=budget)
    with small_batches(news.sparkSession):
        scores = materialize(scored.drop("combined_text"), "scores")
    return (lookup_join(texted, scores, ["text_key"], "inner", salt_by, **join_limits)
            .drop("combined_text", "text_key"))


def _named(make_predict_fn: Callable, labels: tuple[str, ...]) -> Callable:
    def make() -> Callable:
        predict = make_predict_fn()

        def run(batch):
            probabilities = predict(batch)
            return {c: probabilities[:, i] for i, c in enumerate(labels)}

        return run

    return make


# --- scores kept between runs ---


def pending_texts(news: DataFrame, scored: DataFrame, version: str) -> DataFrame:
    """Distinct texts that model ``version`` has not scored yet."""
    done = scored.filter(F.col("model_version") == version).select("text_key").distinct()
    return distinct_texts(news).join(done, "text_key", "left_anti")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The score store; empty before the first run."""
    schema = ("text_key string, negative double, neutral double, positive double, "
              "sentiment_score double, model_version string")
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_scores(todo: DataFrame, make_predict_fn: Callable, path: str, version: str,
                  labels: Sequence[str] = CLASSES, replace: bool = False) -> None:
    """Score ``todo`` into the store; ``replace`` drops the older scores of these texts in this version."""
    fresh = score_distinct(todo, make_predict_fn, labels).drop("combined_text").withColumn("model_version", F.lit(version))
    spark = todo.sparkSession
    if replace:
        with small_batches(spark):
            fresh = materialize(fresh, "scores")
        others = read_scores(spark, path).filter(F.col("model_version") == version).join(
            fresh.select("text_key"), "text_key", "left_anti")
        # the partition is read and written, so its new content is complete before it is replaced
        fresh = materialize(fresh.unionByName(others), "scores")
    with small_batches(spark):
        (fresh.write
         .mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
         .partitionBy("model_version").parquet(path))


def score_with_store(news: DataFrame, make_predict_fn: Callable, path: str, version: str,
                     labels: Sequence[str] = CLASSES, force_refresh: bool = False,
                     salt_by: Sequence[str] = ("Time", "Headlines"),
                     **join_limits: float) -> DataFrame:
    """Score what the store lacks, append it, and join all scores to the news.

    ``force_refresh`` scores every text of ``news`` again; other stored scores stay.
    """
    spark = news.sparkSession
    texted = with_text(news)
    if force_refresh:
        todo = distinct_texts(texted)
    else:
        todo = pending_texts(texted, read_scores(spark, path), version)
    append_scores(todo, make_predict_fn, path, version, labels, replace=force_refresh)
    scores = read_scores(spark, path).filter(F.col("model_version") == version)
    scores = scores.drop("model_version").dropDuplicates(["text_key"])
    return (lookup_join(texted, scores, ["text_key"], "inner", salt_by, **join_limits)
            .drop("combined_text", "text_key"))


# --- a lexicon scorer behind the batch interface, and a trained one ---


def lexicon_predict_fn(positive: Sequence[str], negative: Sequence[str]) -> Callable:
    """``make_predict_fn`` of the word-list model, columns (negative, neutral, positive)."""
    good, bad = frozenset(positive), frozenset(negative)

    def make() -> Callable:
        import numpy as np
        import regex

        words = regex.compile(r"\p{L}+")

        def predict(texts):
            counts = np.ones((len(texts), 3))
            for i, text in enumerate(texts):
                for w in words.findall(text.lower()):
                    counts[i, 2 if w in good else 0 if w in bad else 1] += 1
            return counts / counts.sum(axis=1, keepdims=True)

        return predict

    return make


def text_classifier(features: int = 1 << 14, max_iter: int = 20):
    """MLlib pipeline: tokens, hashed counts, idf, multinomial logistic regression.

    Expects ``text`` and a ``label`` column with the class position in CLASSES.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer

    return Pipeline(stages=[
        Tokenizer(inputCol="text", outputCol="words"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=max_iter, regParam=0.01)])


def score_classifier(model, df: DataFrame, text: str = "text") -> DataFrame:
    """Class columns and score of a fitted ``text_classifier``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.withColumn("text", F.coalesce(text, F.lit(""))))
    probs = vector_to_array("probability")
    scored = out.withColumns({c: probs[i] for i, c in enumerate(CLASSES)})
    return with_score(scored.drop("words", "counts", "features", "rawPrediction", "probability",
                                  "prediction"))
