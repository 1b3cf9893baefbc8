"""Join of a large table with a lookup table of unknown size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.storage import materialize

# A lookup row is some hundred bytes at most: one million of them stay well
# below Spark's 8 GB broadcast limit and fit beside an executor's other memory.
MAX_BROADCAST_ROWS = 1_000_000
# A key is hot if it has this share of the sampled rows, so there are at most
# 1 / HOT_SHARE hot keys. Each is spread over SALTS tasks.
SAMPLE_FRACTION = 0.001
HOT_SHARE = 0.001
SALTS = 64


def hot_keys(large: DataFrame, on: Sequence[str], sample_fraction: float = SAMPLE_FRACTION,
             hot_share: float = HOT_SHARE) -> DataFrame:
    """Written table of the keys that hold a large share of the rows (1 / hot_share at most)."""
    sampled = materialize(large.select(*on).sample(sample_fraction, seed=1).groupBy(*on)
                          .agg(F.count(F.lit(1)).alias("n")), "key_counts")
    total = sampled.agg(F.sum("n")).first()[0] or 0
    hot = sampled.filter(F.col("n") >= max(2.0, hot_share * total)).select(*on)
    return materialize(hot.withColumn("_hot", F.lit(True)), "hot_keys")


def lookup_join(large: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                salt_by: Sequence[str] = (), max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                salts: int = SALTS, sample_fraction: float = SAMPLE_FRACTION,
                hot_share: float = HOT_SHARE) -> DataFrame:
    """Join ``large`` with ``lookup`` (unique on ``on``) without a hot task.

    The lookup's rows are counted first (up to the limit only), so pass a written
    table. Within the limit it is broadcast and ``large`` is not shuffled at all.
    Beyond it both sides are hashed on the key and a salt. The salt is 0 except
    for hot keys: their rows draw it from ``salt_by`` and so spread over many
    tasks, and only their lookup rows are repeated. The sample behind the choice
    of hot keys affects the work split, never the result.
    """
    on = list(on)
    if lookup.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return large.join(F.broadcast(lookup), on, how)
    # bounded by 1 / hot_share rows, hence safe to broadcast
    hot = F.broadcast(hot_keys(large, on, sample_fraction, hot_share))
    spread = [F.col(c) for c in (salt_by or [c for c in large.columns if c not in on])]
    drawn = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = (large.join(hot, on, "left")
              .withColumn("_salt", F.when(F.col("_hot"), drawn).otherwise(F.lit(0))).drop("_hot"))
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = lookup.join(hot, on, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
