"""Keep the score store up to date as news files arrive.

A rerun of a study should not score old texts again. As a stream, the file
source's checkpoint skips files that were handled, and the store's anti join
skips texts that were scored; a micro-batch that is replayed after a failure
adds nothing new.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from signalspark.operators.scoring import (
    CLASSES, append_scores, pending_texts, read_scores, with_text)

NEWS_SCHEMA = "Headlines string, Time timestamp_ntz, Description string"


def follow_news(spark: SparkSession, news_folder: str, store: str, checkpoint: str,
                make_predict_fn: Callable, version: str, labels: Sequence[str] = CLASSES,
                schema: str = NEWS_SCHEMA) -> StreamingQuery:
    """Score all news files not handled yet, then stop; run it again for newer files."""

    def handle(batch: DataFrame, _: int) -> None:
        todo = pending_texts(with_text(batch), read_scores(batch.sparkSession, store), version)
        append_scores(todo, make_predict_fn, store, version, labels)

    return (spark.readStream.schema(schema).parquet(news_folder)
            .writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
