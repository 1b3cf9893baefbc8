"""Decay features kept current as scored news arrives, in any order and with late days.

What a batch of news adds to a day is a few sums per session minute, and sums of batches
add up to the sums of all news. ``DecayStore`` keeps the sums of each batch in a folder
named by the batch, so that a batch that is replayed replaces itself, and folds them into
one table now and then. Every decay configuration is computed from the merged sums.

The half-life memory of an entity is linear in its days. Its state (first day, last day,
weighted sum as of the last day) is merged by carrying both sums to the later last day, so
a late day, or a day whose mean has changed, is added to the state without the history.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalspark.functions.decay import HalfLifeDecay
from signalspark.operators.daily import KEYS
from signalspark.params import SweepParams
from signalspark.plans.sweep import merged_minutes, minute_totals, sweep_minutes

MINUTES = ("Ticker string, Date date, normalized_time double, items bigint, n bigint, s1 double, s2 double, "
           "lo double, hi double, batch bigint")
SCORED = "Ticker string, Date date, Time timestamp_ntz, sentiment_score double"
#: Batches that are kept apart before they are folded into one table.
FOLD_AFTER = 50


class DecayStore:
    """Minute sums of all news of a folder; one writer at a time.

    ``path/batches/batch=N`` holds the sums of one batch, ``path/folded/upto=N-...`` those of
    all batches up to N. A folded table counts once it is complete (Spark's success marker);
    the batches that it covers are left out from then on.
    """

    def __init__(self, spark: SparkSession, path: str, fold_after: int = FOLD_AFTER):
        self.spark, self.path, self.fold_after = spark, path.rstrip("/"), fold_after

    def add(self, scored: DataFrame, batch: int) -> None:
        """Add the news of one batch; the same number again replaces what it added before."""
        folded = self._folded()
        if folded and batch <= folded[0]:
            return  # replayed after it was folded in
        totals = minute_totals(scored).select(*[f.split()[0] for f in MINUTES.split(", ")[:-1]])
        totals.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")
        if len(self._batches(folded[0] if folded else -1)) > self.fold_after:
            self.minutes().write.parquet(f"{self.path}/folded/upto={batch}-{uuid.uuid4().hex}")

    def minutes(self) -> DataFrame:
        """Merged minute sums of all batches."""
        folded = self._folded()
        upto = folded[0] if folded else -1
        apart = self._read(f"{self.path}/batches", MINUTES).filter(F.col("batch") > upto).drop("batch")
        if folded:
            apart = apart.unionByName(self.spark.read.schema(apart.schema).parquet(f"{self.path}/folded/{folded[1]}"))
        return merged_minutes(apart)

    def features(self, params: SweepParams = SweepParams()) -> DataFrame:
        """Daily features of all decay configurations, as ``sweep_daily`` of all news gives them."""
        return sweep_minutes(self.minutes(), params)

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _names(self, folder: str) -> list[str]:
        """Folders below ``folder`` that were written to the end."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(f"{self.path}/{folder}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        return [s.getPath().getName() for s in files.listStatus(root) if files.exists(jvm.Path(s.getPath(), "_SUCCESS"))]

    def _folded(self) -> tuple[int, str] | None:
        """(last batch, folder) of the newest folded table."""
        return max(((int(n.split("=")[1].split("-")[0]), n) for n in self._names("folded")), default=None)

    def _batches(self, after: int) -> list[int]:
        return [b for b in (int(n.split("=")[1]) for n in self._names("batches")) if b > after]


def follow_decay(spark: SparkSession, news_folder: str, store: str, checkpoint: str,
                 schema: str = SCORED, fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """Add all scored, aligned news files not handled yet to the store, then stop; run it again for newer files."""
    kept = DecayStore(spark, store, fold_after)
    return (spark.readStream.schema(schema).parquet(news_folder)
            .writeStream.foreachBatch(lambda batch, number: kept.add(batch, number))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- the half-life memory as a state that can be merged ---


def memory_state(days: DataFrame, decay: HalfLifeDecay, version: int = 0, score: str = "sent_mean",
                 before: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(entity, first, last, w) of some days: w is the sum of alpha * score * keep ** (last - day).

    ``before`` names a column with the score that an earlier state has for the day (null:
    none); the state then holds the change. ``version`` rises with each state of an entity.
    """
    *entity, date = keys
    day = F.unix_date(date).cast("long")
    known = days.filter(F.col(score).isNotNull()).withColumns({"_day": day, "_last": F.max(day).over(Window.partitionBy(*entity))})
    change = F.col(score) - (F.coalesce(before, F.lit(0.0)) if before else F.lit(0.0))
    # the newest version of the first day counts, so it sorts first
    first = F.struct(F.col("_day").alias("day"), F.lit(-version).alias("version"), F.col(score).alias("score"))
    return known.groupBy(*entity).agg(F.min(first).alias("first"), F.max("_day").alias("last"), F.sum(
        F.lit(decay.alpha) * change * F.pow(F.lit(decay.keep), F.col("_last") - F.col("_day"))).alias("w"))


def merge_states(states: DataFrame, decay: HalfLifeDecay, entity: Sequence[str] = KEYS[:-1]) -> DataFrame:
    """One state per entity from several, in any order."""
    carried = states.withColumn("_last", F.max("last").over(Window.partitionBy(*entity)))
    carried = carried.withColumn("w", F.col("w") * F.pow(F.lit(decay.keep), F.col("_last") - F.col("last")))
    return carried.groupBy(*entity).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("w").alias("w"))


def newest_memory(states: DataFrame, decay: HalfLifeDecay, entity: Sequence[str] = KEYS[:-1]) -> DataFrame:
    """(entity, Date, sentiment_memory) at the last day of each state: the first day counts fully, others by alpha."""
    rest = F.lit(1.0 - decay.alpha) * F.col("first.score") * F.pow(F.lit(decay.keep), F.col("last") - F.col("first.day"))
    return states.select(*entity, F.date_from_unix_date(F.col("last").cast("int")).alias("Date"), (F.col("w") + rest).alias("sentiment_memory"))
