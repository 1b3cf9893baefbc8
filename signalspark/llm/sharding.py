"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Documents get global row numbers in the order of (id, size, checksum). A keyed
Feistel network over ``side * side`` pairs, with ``side = ceil(sqrt(n))``, permutes
them; numbers that land outside ``0..n-1`` walk on along their cycle until they
are inside, so the whole is a permutation of ``0..n-1``. With permuted number
``p`` a row goes to shard ``p % shards``, slot ``p // shards``: shard sizes differ
by one at most, slots have no gaps, and both can be computed from the number.

Only (id, size, checksum) leaves the scan. Equal rows are counted before the
shuffle, so a row that repeats a third of the table is one row per task; it is
spread again in blocks. Null ids sort first, null texts count as empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.storage import materialize

SHARDS = 8
SEED = 2024
ROUNDS = 6
BLOCK = 4096
PRIME = 2147483647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and offset of each round, drawn from the seed by a linear congruence."""
    state, keys = seed % PRIME, []
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = (state * 48271 + 11) % PRIME
            pair.append(state)
        keys.append((pair[0] | 1, pair[1]))
    return keys


def global_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, unique on ``order`` and with a count ``n``, plus ``_first``: rows before it.

    Rows are dealt by ranges of ``order``; only one total per range meets in a window.
    """
    dealt = materialize(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                        .withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (dealt.groupBy("_range").agg(F.sum("n").alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    within = (Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = dealt.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # one row per range of the sort, as many as shuffle partitions
    return (numbered.join(F.broadcast(totals), "_range")
            .withColumn("_first", F.col("_within") + F.col("_offset")).drop("_range", "_within", "_offset"))


def feistel(df: DataFrame, number: str, side: int, keys: list[tuple[int, int]]) -> DataFrame:
    """``number`` in ``0..side*side-1`` replaced by its image, one column step per round."""
    df = df.withColumns({"_l": _div(F.col(number), side),
                         "_r": F.col(number) % side})
    for multiplier, offset in keys:
        df = df.withColumn("_t", (F.col("_r") * multiplier + offset) % PRIME)
        df = df.withColumn("_f", (F.col("_t") * F.col("_t") % PRIME + _div(F.col("_t"), 65536)) % side)
        df = df.withColumns({"_l": F.col("_r"), "_r": (F.col("_l") + F.col("_f")) % side})
    return df.withColumn(number, F.col("_l") * side + F.col("_r")).drop("_l", "_r", "_t", "_f")


def _div(value: Column, by: int) -> Column:
    """Whole part of a quotient of non-negative longs."""
    return ((value - value % by) / by).cast("long")


def permuted(df: DataFrame, number: str, n: int, seed: int = SEED) -> DataFrame:
    """``number`` in ``0..n-1`` replaced by its place in the shuffle.

    About ``2 * sqrt(n)`` of the ``side * side`` numbers lie outside; each walk of
    those that landed there is one pass over them alone, until none is left.
    """
    side = math.isqrt(max(n - 1, 0)) + 1
    keys = round_keys(seed)
    moved = materialize(feistel(df, number, side, keys), "permuted")
    done, outside = moved.filter(F.col(number) < n), moved.filter(F.col(number) >= n)
    while outside.limit(1).count():
        moved = materialize(feistel(outside, number, side, keys), "walked")
        done = done.unionByName(moved.filter(F.col(number) < n))
        outside = moved.filter(F.col(number) >= n)
    return done


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, number, shard, slot) per document; an empty table gives no rows.

    ``number`` is the place in the shuffle. ``size`` is the text's UTF-8 bytes plus one.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw).cast("long") + 1).alias("size"),
                       F.crc32(raw).alias("text_crc32"))
    counted = slim.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    numbered = materialize(global_numbers(counted, ["id", "size", "text_crc32"]), "numbered")
    total = numbered.agg(F.sum("n")).first()[0] or 0
    # equal rows come apart again in blocks, each block dealt on its own
    blocks = (numbered.withColumn("_block", F.explode(F.sequence(F.lit(0), _div(F.col("n") - 1, BLOCK))))
              .repartition("id", "_block"))
    here = F.least(F.lit(BLOCK), F.col("n") - F.col("_block") * BLOCK)
    rows = (blocks.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), here.cast("long") - 1)))
            .withColumn("number", F.col("_first") + F.col("_block") * BLOCK + F.col("_k"))
            .select("id", "size", "text_crc32", "number"))
    placed = permuted(rows, "number", total, seed)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "number",
                         (F.col("number") % shards).cast("int").alias("shard"),
                         _div(F.col("number"), shards).alias("slot"))
