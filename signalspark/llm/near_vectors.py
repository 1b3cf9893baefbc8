"""All vector pairs with cosine at or above a threshold, by PCA-ordered tiles.

Vectors are scaled to length 1 and rotated to their principal axes, found from
sums over all rows. Equal vectors are counted once. The rest is sorted along the
first axis and cut into tiles; two tiles meet only if their ranges on that axis
come within the distance that the threshold allows. A pair of tiles adds up the
products of the leading axes first. What the other axes can add is bounded by the
product of the suffix norms, and a pair whose bound stays below the threshold is
dropped; pairs that remain are compared by the full cosine of the given vectors in
double precision. Each meeting of tiles is a task of its own, so a crowded place
is many tasks; only link counts and one edge per linked vector leave it.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do vectors of different length. Ids that repeat are separate
rows of one vector id: links count rows, and rows of an id share its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.components import connected_components
from signalspark.llm.sharding import global_numbers
from signalspark.storage import materialize

COSINE = 0.95
TILE = 2048
#: Axes added up before the first bound, then before the second.
LEADING = (8, 24)
#: Rounding of rotated single products; the final comparison is on the given vectors.
SLACK = 1e-6


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, vector) of vectors that can link."""
    for batch in batches:
        ids, vectors, sizes = [], [], []
        for i, v in zip(batch.column("id"), batch.column("vector"), strict=True):
            x = v.as_py()
            if x is None or not len(x) or any(e is None for e in x):
                continue
            x = np.asarray(x, np.float64)
            with np.errstate(over="ignore"):
                norm = np.sqrt(np.dot(x, x))
            if np.isfinite(x).all() and np.isfinite(norm) and norm > 0:
                ids.append(i.as_py())
                vectors.append(x)
                sizes.append(len(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(vectors, pa.list_(pa.float64()))],
            names=["id", "size", "vector"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector length, the sum of outer products of a task's unit vectors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            x = _matrix(batch.column("vector").filter(pa.array(sizes == size)), int(size))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[int(size)] = sums.get(int(size), 0) + x.T @ x
    for size, m in sums.items():
        n = size * size
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                                          pa.array(m.ravel())], names=["size", "cell", "value"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Rotation per vector length, strongest axis first."""
    cells = vectors.mapInArrow(_moments, "size int, cell int, value double").groupBy("size", "cell").agg(
        F.sum("value").alias("value")).toPandas()
    out = {}
    for size, part in cells.groupby("size"):
        m = part.sort_values("cell")["value"].to_numpy().reshape(size, size)
        _, axes = np.linalg.eigh((m + m.T) / 2)
        out[int(size)] = np.ascontiguousarray(axes[:, ::-1])
    return out


def _rotated(axes: dict[int, np.ndarray]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            first = np.zeros(len(batch))
            for size in np.unique(sizes):
                x = _matrix(batch.column("vector").filter(pa.array(sizes == size)), int(size))
                first[sizes == size] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[int(size)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=[*batch.schema.names, "axis"])
    return step


def _pairs_of(axes: dict[int, np.ndarray], threshold: float):
    """Link counts and edges of one meeting of tiles."""
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["side"] == 0]
        other = rows[rows["side"] == 1]
        size = int(rows["size"].iloc[0])
        same = not len(other)
        a, b = own, own if same else other
        if not len(a):
            return _links([], [], [])
        raw_a = np.stack(a["vector"].to_numpy())
        raw_b = raw_a if same else np.stack(b["vector"].to_numpy())
        norm_a, norm_b = np.linalg.norm(raw_a, axis=1), np.linalg.norm(raw_b, axis=1)
        x, y = (raw_a / norm_a[:, None]) @ axes[size], (raw_b / norm_b[:, None]) @ axes[size]
        k1, k2 = (min(k, size) for k in LEADING)
        rest = lambda z, k: np.sqrt(np.maximum((z[:, k:] ** 2).sum(axis=1), 0.0))
        # leading axes, with the suffix norm as one more coordinate: the product is the bound itself
        bound = (np.column_stack([x[:, :k1], rest(x, k1)]).astype(np.float32)
                 @ np.column_stack([y[:, :k1], rest(y, k1)]).astype(np.float32).T)
        i, j = np.nonzero(bound >= threshold - 1e-4)
        if same:
            i, j = i[i < j], j[i < j]
        n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        w_a, w_b = a["weight"].to_numpy(), b["weight"].to_numpy()
        ra, rb = rest(x, k2), rest(y, k2)
        linked, cut = [], 1 << 17
        for s in range(0, len(i), cut):
            p, q = i[s:s + cut], j[s:s + cut]
            more = np.einsum("ij,ij->i", x[p, :k2], y[q, :k2]) + ra[p] * rb[q]
            p, q = p[more >= threshold - SLACK], q[more >= threshold - SLACK]
            cos = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / (norm_a[p] * norm_b[q])
            p, q = p[cos >= threshold], q[cos >= threshold]
            n_a += np.bincount(p, w_b[q], len(a)).astype(np.int64)
            n_b += np.bincount(q, w_a[p], len(b)).astype(np.int64)
            linked.append((p.astype(np.int32), q.astype(np.int32)))
        p = np.concatenate([x[0] for x in linked] or [np.zeros(0, np.int32)])
        q = np.concatenate([x[1] for x in linked] or [np.zeros(0, np.int32)])
        root_a = a["id"].to_numpy().copy()
        root_b = root_a if same else b["id"].to_numpy().copy()
        while True:  # the smallest id spreads along the links of this meeting
            least = np.minimum(root_a[p], root_b[q])
            if (root_a[p] == least).all() and (root_b[q] == least).all():
                break
            np.minimum.at(root_a, p, least)
            np.minimum.at(root_b, q, least)
        if same:
            n_a = n_a + n_b
            return _links(a["id"][n_a > 0], n_a[n_a > 0], root_a[n_a > 0])
        ha, hb = n_a > 0, n_b > 0
        return _links(np.concatenate([a["id"][ha], b["id"][hb]]), np.concatenate([n_a[ha], n_b[hb]]),
                      np.concatenate([root_a[ha], root_b[hb]]))
    return step


def _links(ids, n, root) -> pd.DataFrame:
    return pd.DataFrame({"id": np.asarray(ids, np.int64), "n": np.asarray(n, np.int64), "root": np.asarray(root, np.int64)})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = COSINE,
                 tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``df``; an empty table gives no rows."""
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("id", F.coalesce("row_id", F.lit(-(1 << 63)))).withColumn("digest", F.xxhash64("vector"))
    # arrays with nulls or NaN group as they are and are left out next
    classes = rows.groupBy("digest", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    usable = materialize(classes.select("id", "vector").mapInArrow(_usable, "id long, size int, vector array<double>"),
                         "usable")
    n = usable.count()
    if n == 0:
        found = df.sparkSession.createDataFrame([], "id long, n long, root long")
        weights = usable.select("id", F.lit(1).alias("weight"))
    else:
        axes = principal_axes(usable)
        weights = classes.select(F.xxhash64("vector").alias("digest"), "id", "weight", "vector")
        placed = usable.mapInArrow(_rotated(axes), "id long, size int, vector array<double>, axis double")
        counted = placed.withColumn("digest", F.xxhash64("vector")).join(
            weights.select("digest", "weight", F.col("vector").alias("_v")), "digest").filter("vector = _v").drop("_v")
        numbered = global_numbers(counted.withColumn("n", F.lit(1)), ["size", "axis", "digest"])
        tiled = materialize(numbered.withColumn("tile", F.floor(F.col("_first") / tile)).drop("_first", "n"), "tiles")
        found = materialize(_meetings(tiled, threshold).groupBy("own", "partner")
                            .applyInPandas(_pairs_of(axes, threshold), "id long, n long, root long"), "links")
    components = connected_components(found.select("id", "root"), "id", "root")
    per_class = (found.groupBy("id").agg(F.sum("n").alias("n")).join(
        components.withColumnRenamed("node", "id"), "id", "left"))
    return _labelled(rows, classes, usable.select("id", F.xxhash64("vector").alias("digest")), per_class, id_col)


def _meetings(tiled: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``tiled`` once per meeting of their tile: (own, partner, side)."""
    reach = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + SLACK
    stats = sorted(tiled.groupBy("size", "tile").agg(F.min("axis"), F.max("axis")).collect())  # one row per tile
    upto, back = [], []
    last = first = 0
    for k, (size, _, _, high) in enumerate(stats):
        last = max(last, k)
        while last + 1 < len(stats) and stats[last + 1][0] == size and stats[last + 1][2] <= high + reach:
            last += 1
        upto.append(last)
        while upto[first] < k:
            first += 1
        back.append(first)
    plan = tiled.sparkSession.createDataFrame(
        [(row[0], row[1], k, back[k], upto[k]) for k, row in enumerate(stats)],
        "size int, tile long, k int, back int, upto int")
    # with each later tile as its own side, with each earlier one as the other
    meets = F.concat(
        F.transform(F.sequence("k", "upto"), lambda m: F.struct(F.col("k").alias("own"), m.alias("partner"), F.lit(0).alias("side"))),
        F.when(F.col("back") < F.col("k"), F.transform(F.sequence(F.col("back"), F.col("k") - 1), lambda m: F.struct(
            m.alias("own"), F.col("k").alias("partner"), F.lit(1).alias("side")))).otherwise(F.array()))
    return (tiled.join(F.broadcast(plan), ["size", "tile"]).withColumn("_m", F.explode(meets))
            .select("_m.*", "id", "size", "vector", "weight"))


def _labelled(rows: DataFrame, classes: DataFrame, usable: DataFrame, per_class: DataFrame, id_col: str) -> DataFrame:
    """Links and component of every row from those of its class."""
    known = (classes.select("digest", "id", "weight").join(usable, ["digest", "id"])
             .join(per_class, "id", "left")
             .select("digest", F.col("id").alias("class_id"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("component")))
    out = rows.select("row_id", "id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("row_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(component != -(1 << 63), component).alias("component_id"),
                      (F.col("id") == component).alias("kept"))
