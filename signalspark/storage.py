"""Written intermediate tables.

A study reuses its daily tables (bars, calendars, feature tables) many times.
``materialize`` writes such a table once and reads it back: the lineage is cut,
a lost executor costs a re-read instead of a re-scan of the raw data, and the
file sizes give the optimizer true statistics for its join choice.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
local session without that setting falls back to a folder under the system's
temporary directory; a cluster without it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that a Python worker gets at once where whole texts go through Python.
TEXT_ROWS = 512
_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables of this session."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="signalspark-")
    return _local_dirs[app]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the written table.

    What the write shuffled leaves the executors' disks when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs started inside hand at most ``rows`` rows at once to a Python worker.

    Its memory then depends on that number, not on the size of a partition. Results are the same.
    """
    before = spark.conf.get(ARROW_ROWS_CONF)
    spark.conf.set(ARROW_ROWS_CONF, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS_CONF, before)
