"""Toxicity of documents: a bidirectional gated recurrent network over overlapping windows.

A text is cut into lower-case words (of 24 characters at most, longer ones in pieces) and
into windows of ``WINDOW`` words, ``STRIDE`` apart, to its end. Its score is the highest
window's. Labels belong to documents, so training takes a document as toxic if any of
its windows is (noisy or), and thereby learns which windows are.

Trained in one task on a bounded sample: of each label the ``TRAIN_DOCS`` documents of
least id hash, of each of these at most ``TRAIN_WINDOWS`` windows, evenly drawn from the
whole text. The weights, some two megabytes, go to all tasks. All texts are scored in Arrow batches, each different word of a batch looked
up once; nothing is shuffled.

Null and empty texts are one window without words. A null id is not held out and has no
label. Conflicting labels of an id count as toxic. Without a label of both kinds there is
no model, and the score is the share of toxic labels (0 without any). Further
columns are not looked at.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm import gru

WINDOW, STRIDE = 32, 16
#: Bounds of the training sample: documents per label, windows per document.
TRAIN_DOCS, TRAIN_WINDOWS = 1500, 48
#: Steps of the training, of GROUP documents each, whatever the sample's size.
STEPS, RATE, GROUP, UNKNOWN = 400, 0.01, 24, 0.5
#: Windows that run through the network at once.
CHUNK = 4096
WORD = re.compile(r"\w{1,24}")


def held_out(doc_id: Column) -> Column:
    """Documents whose label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def windows_of(n_words: int) -> np.ndarray:
    """Starts of the windows of a text; the last one ends with it."""
    last = max(0, n_words - WINDOW)
    return np.append(np.arange(0, last, STRIDE), last)


def prepared(texts: list[str], most: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, windows of their places, first window of each text)."""
    index: dict[str, int] = {}
    rows, first = [], []
    count = 0
    for text in texts:
        ids = np.fromiter((index.setdefault(w, len(index)) for w in WORD.findall(text.lower())), np.int64)
        starts = windows_of(len(ids))
        if most and len(starts) > most:
            starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
        ids = np.append(ids, np.full(max(0, WINDOW - len(ids)), -1))
        rows.append(ids[starts[:, None] + np.arange(WINDOW)])
        first.append(count)
        count += len(starts)
    windows = np.concatenate(rows)
    words = list(index) or [""]
    windows[windows < 0] = len(words)
    return words, windows, np.array(first)


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> gru.Params:
    """Network trained by Adam on groups of documents; ``labels`` are 0 and 1."""
    rng = np.random.default_rng(seed)
    p = gru.fresh(seed)
    adam = gru.Adam(p, RATE)
    order = np.zeros(0, int)
    for step in range(steps):
        if len(order) < GROUP:
            order = np.append(order, rng.permutation(len(texts)))
        mine, order = order[:GROUP], order[GROUP:]
        adam.rate = RATE * (1 - step / steps)
        words, windows, first = prepared([texts[i] for i in mine], TRAIN_WINDOWS)
        # half of the words are known by their characters only, so that rare words are not learned by heart
        seen = np.ones((len(words), 2 * gru.EMBED), np.float32)
        seen[rng.random(len(words)) < UNKNOWN, :gru.EMBED] = 0
        _, grad = loss_and_gradient(p, words, windows, first, labels[mine], seen)
        size = np.sqrt(sum(float((d * d).sum()) for d in grad.values()))
        adam.step(p, {name: d * min(1.0, 1.0 / max(size, 1e-9)) for name, d in grad.items()})
    return p


def loss_and_gradient(p: gru.Params, words: list[str], windows: np.ndarray, first: np.ndarray,
                      labels: np.ndarray, seen: np.ndarray | None = None) -> tuple[float, gru.Params]:
    """Mean log loss of documents that are toxic if any of their windows is; ``seen`` masks the words' inputs."""
    known = gru.hashed(words)
    seen = np.ones((len(words), 2 * gru.EMBED), p["word"].dtype) if seen is None else seen
    x = gru.inputs(p, known) * seen
    g = gru.projected(p, x)
    logit, saved = gru.forward(p, g, windows, keep=True)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(windows))))
    log_clean = -np.logaddexp(0, logit)  # log(1 - p) of a window
    log_none = np.minimum(np.add.reduceat(log_clean, first), -1e-7)  # of a document
    some = -np.expm1(log_none)
    loss = -np.where(labels == 1, np.log(some), log_none).mean()
    d_none = np.where(labels == 1, (1 - some) / some, -1.0) / len(labels)
    d_logit = (-d_none[of] / (1 + np.exp(-logit))).astype(logit.dtype)
    grad, d_g = gru.backward(p, g, saved, d_logit)
    return float(loss), grad | gru.input_gradients(p, known, x, d_g, seen)


def scores(p: gru.Params, texts: list[str]) -> np.ndarray:
    """Score of every text: that of its highest window."""
    words, windows, first = prepared(texts)
    g = gru.projected(p, gru.inputs(p, gru.hashed(words)))
    logit = np.concatenate([gru.forward(p, g, windows[k:k + CHUNK])[0] for k in range(0, len(windows), CHUNK)])
    return 1 / (1 + np.exp(-np.maximum.reduceat(logit, first).astype(float)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str,
                    limit: int = TRAIN_DOCS) -> DataFrame:
    """(_id, _label, _text) to learn from, never held-out ids; at most ``limit`` of each label."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label")).withColumn("_hash", F.xxhash64("_id")))
    picked = [known.filter(F.col("_label") == v).orderBy("_hash", "_id").limit(limit).drop("_hash") for v in (0, 1)]
    # two times ``limit`` ids at most
    wanted = F.broadcast(picked[0].unionByName(picked[1]))
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(wanted, "_id")
    # a text is cut to the words that training looks at before it travels; rows of one id are taken once
    cut = found.mapInArrow(_cut, "_id long, _label int, _text string")
    return cut.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts down to the words of ``TRAIN_WINDOWS`` windows."""
    for batch in batches:
        texts = []
        for text in batch.column("_text").to_pylist():
            words = WORD.findall(text.lower())
            starts = windows_of(len(words))
            if len(starts) > TRAIN_WINDOWS:
                starts = starts[np.linspace(0, len(starts) - 1, TRAIN_WINDOWS).astype(int)]
                words = [w for s in starts for w in words[s:s + WINDOW]]
            texts.append(" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("_label").cast(pa.int32()),
                                          pa.array(texts, pa.string())], names=["_id", "_label", "_text"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounded sample to one row: share of toxic labels, and the weights if there are both labels."""
    rows = pa.Table.from_batches(list(batches), pa.schema(
        [("_id", pa.int64()), ("_label", pa.int32()), ("_text", pa.string())])).sort_by("_id")
    labels = rows.column("_label").to_numpy()
    weights = None
    if len(set(labels.tolist())) == 2:
        file = io.BytesIO()
        np.savez(file, **fit(rows.column("_text").to_pylist(), labels))
        weights = file.getvalue()
    yield pa.RecordBatch.from_pylist([{"share": float(labels.mean()) if len(labels) else 0.0, "weights": weights}],
                                     pa.schema([("share", pa.float64()), ("weights", pa.binary())]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = dict(np.load(io.BytesIO(shared.value)))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores(p, texts), pa.float64())], names=["id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; ``labels`` (id, ``label`` of 0 or 1)."""
    sample = training_sample(docs, labels, label, id_col, text_col)
    model = sample.repartition(1).mapInArrow(_fit, "share double, weights binary").first()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model and model.weights:
        shared = docs.sparkSession.sparkContext.broadcast(bytes(model.weights))
        kind = slim.schema["id"].dataType.simpleString()
        scored = slim.mapInArrow(_score(shared), f"id {kind}, score double")
    else:
        scored = slim.select("id", F.lit(model.share if model else 0.0).alias("score"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
