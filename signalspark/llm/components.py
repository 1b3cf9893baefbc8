"""Connected components of a distributed edge table.

Rounds of large-star and small-star: every node hands its larger neighbours, then
its smaller ones, to the smallest node it knows, until no edge changes. Stars, the
usual shape of duplicate groups, are done after one round. Minimums are partial
aggregates and the joins are plain equi-joins, which adaptive execution splits when
one node has most of the edges. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.storage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; component is its smallest node."""
    current = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(current)
    while state[0]:
        ends = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (ends.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        current = materialize(small, "edges")
        state, before = _state(current), state
        if state == before:
            break
    # now every node points at the smallest node of its component
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free digest of an edge set."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
