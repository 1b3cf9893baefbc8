"""Whole groups from a stream of Arrow batches that is sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch; texts are some kilobytes, and a task holds a batch several times.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
GROUP_ROWS = 20_000


def modest_batches(spark: SparkSession) -> SparkSession:
    """Let no Arrow batch of this session have more rows than ``BATCH_ROWS``; a lower setting stays."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    return spark


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = GROUP_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows that never cut a run of equal ``key`` (a long column)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for start in range(0, len(batch), rows):
            part = batch.slice(start, rows)
            held.append(part)
            size += len(part)
            if size < rows:
                continue
            whole = _joined(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield whole.slice(0, cut)
            held, size = [whole.slice(cut)], size - cut
    if size:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def spread_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label within reach over the links (a[i], b[i])."""
    labels = labels.copy()
    while True:
        least = np.minimum(labels[a], labels[b])
        if (labels[a] == least).all() and (labels[b] == least).all():
            return labels
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
