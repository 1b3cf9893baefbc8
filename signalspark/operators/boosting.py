"""Gradient-boosted trees of many models at once, by histograms.

Features are cut into ``BINS`` ranges by quantiles, so a row is one byte per feature. A
level of all current trees is one pass over the rows: each task adds up gradient and
curvature per (model, node, feature, bin), the sums of a model meet by (model, node),
where the best split is chosen, and only the splits (one row per node) come to the
driver and go out with the next pass. Rows carry a range of folds and are read once
for all of them; no training set is gathered.

Models of up to ``TASK_CELLS`` training cells, a checked size, need no passes: all
their trees are grown where their rows meet, by the same sums and the same choice of
splits. Hundreds of small models of a sweep are then one job.

Log loss with second-order gains, an L2 penalty on leaves and a least curvature per child.
Ties go to the first feature and the lowest bin.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.operators.fold_table import RANGES, FoldTable
from signalspark.operators.folds import TEST, TRAIN
from signalspark.storage import materialize

BINS = 64
#: Bytes of binned training rows up to which a model is grown in one task.
TASK_CELLS = 1 << 26
#: Trees that a pass applies to rows before their margins are written again.
PENDING = 10
#: Bytes of trees that go out together for predictions; more models go in turns.
BROADCAST_BYTES = 1 << 28


@dataclass(frozen=True)
class BoostParams:
    """Settings of the boosted trees."""

    trees: int = 100
    depth: int = 5
    rate: float = 0.1
    penalty: float = 1.0
    least_curvature: float = 1.0


@dataclass
class Trees:
    """Complete binary trees as arrays (tree, node); node k has the children 2k+1 and 2k+2.

    ``feature`` is -1 at leaves. Rows with a bin up to ``cut`` go left. ``gain`` is that of
    the split, ``cover`` the curvature of the node's rows, ``value`` the margin of a leaf.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        shape = (trees, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), *(np.zeros(shape) for _ in range(3)))

    def __len__(self) -> int:
        return len(self.feature)

    def pack(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, **vars(self))
        return file.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Trees:
        with np.load(io.BytesIO(data)) as held:
            return cls(**{k: held[k] for k in ("feature", "cut", "value", "gain", "cover")})

    def node_of(self, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node that each row reaches in ``levels`` steps; rows stay at leaves."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[tree, at]
            right = bins[rows, np.maximum(feature, 0)] > self.cut[tree, at]
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return at

    def margin(self, bins: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Sum of the leaf values of some trees, for each row."""
        total = np.zeros(len(bins))
        depth = (self.feature.shape[1] + 1).bit_length() - 2
        for tree in range(first, len(self) if last is None else last):
            total += self.value[tree, self.node_of(tree, bins, depth)]
        return total


def quantile_edges(rows: DataFrame, width: int, bins: int = BINS) -> DataFrame:
    """(group, edges): per feature the distinct quantiles of all rows of the group, by mergeable sketches.

    Edges come from the features of all days, never from labels; a value goes to the
    number of edges below it.
    """
    shares = [k / bins for k in range(1, bins)]
    sketches = [F.percentile_approx(F.element_at("x", i + 1), shares, 10_000) for i in range(width)]
    return rows.groupBy("group").agg(F.array(*[F.array_distinct(s) for s in sketches]).alias("edges"))


def binned(table: FoldTable) -> DataFrame:
    """The rows of ``table`` with ``bins``, a byte per feature, in place of ``x``; written."""
    rows = table.rows
    known: dict[str, list[np.ndarray]] = {}
    for width, in rows.select(F.size("x")).distinct().collect():
        edges = quantile_edges(rows.filter(F.size("x") == width), width)
        # one row per group, as many as scales
        known |= {r.group: [np.asarray(e, float) for e in r.edges] for r in edges.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(len(batch), object)
            groups = np.array(batch.column("group").to_pylist(), object)
            x = batch.column("x")
            for group in set(groups.tolist()):
                mine = np.flatnonzero(groups == group)
                values = x.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                codes = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(shared.value[group])], axis=1).astype(np.uint8)
                for k, row in zip(mine, codes):
                    out[k] = row.tobytes()
            kept = batch.drop_columns(["x"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.binary())], names=[*kept.schema.names, "bins"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")
    return materialize(rows.mapInArrow(cut, f"{kinds}, bins binary"), "binned")


def histograms(bins: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """(2, nodes, features, BINS): sums of gradient and curvature per node, feature and bin."""
    width = bins.shape[1]
    place = ((node[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    shape = (nodes, width, BINS)
    size = nodes * width * BINS
    return np.stack([np.bincount(place, np.repeat(w, width), size).reshape(shape) for w in (gradient, curvature)])


def best_splits(sums: np.ndarray, p: BoostParams) -> dict[str, np.ndarray]:
    """Per node of ``histograms``: feature (-1: none gains), cut, gain, and the sums left and right."""
    left = np.cumsum(sums, axis=3)[..., :-1]
    total = sums[:, :, :1].sum(axis=3, keepdims=True)
    right = total - left
    score = lambda s: s[0] ** 2 / (s[1] + p.penalty)
    gain = (score(left) + score(right) - score(total)) / 2
    # sums of no rows differ from 0 by rounding alone
    allowed = (left[1] >= p.least_curvature - 1e-9) & (right[1] >= p.least_curvature - 1e-9) & (gain > 1e-9)
    flat = np.where(allowed, gain, -np.inf).reshape(len(gain), -1)
    # gains that differ by rounding alone are ties, whatever the order of the sums was
    best = np.argmax(flat >= flat.max(axis=1, keepdims=True) * (1 - 1e-9), axis=1)
    nodes, cuts = np.arange(len(gain)), gain.shape[2]
    feature, cut = best // cuts, best % cuts
    some = np.isfinite(flat[nodes, best])
    return {"feature": np.where(some, feature, -1), "cut": cut, "gain": np.where(some, flat[nodes, best], 0.0),
            "left": left[:, nodes, feature, cut], "right": right[:, nodes, feature, cut], "total": total[:, :, 0, 0]}


def place_splits(trees: Trees, tree: int, node: np.ndarray, found: dict[str, np.ndarray], p: BoostParams) -> None:
    """Write the splits of some nodes of a level into ``trees``, and the values and covers of their children."""
    value = lambda s: -p.rate * s[0] / (s[1] + p.penalty)
    first = node == 0
    trees.value[tree, node[first]] = value(found["total"][:, first])
    trees.cover[tree, node[first]] = found["total"][1, first]
    some = found["feature"] >= 0
    at = node[some]
    trees.feature[tree, at], trees.cut[tree, at], trees.gain[tree, at] = (found[k][some] for k in ("feature", "cut", "gain"))
    for child, side in ((2 * at + 1, "left"), (2 * at + 2, "right")):
        trees.value[tree, child] = value(found[side][:, some])
        trees.cover[tree, child] = found[side][1, some]


def slopes(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss."""
    proba = 1 / (1 + np.exp(-margin))
    return proba - y, proba * (1 - proba)


def grow(bins: np.ndarray, y: np.ndarray, p: BoostParams) -> Trees:
    """All trees of one model whose rows are at hand."""
    trees = Trees.empty(p.trees, p.depth)
    margin = np.zeros(len(y))
    for tree in range(p.trees):
        gradient, curvature = slopes(y, margin)
        at = np.zeros(len(y), np.int64)
        for level in range(p.depth):
            open_nodes, slot = np.unique(at, return_inverse=True)
            alive = open_nodes >= 2**level - 1  # rows at leaves of upper levels are done
            if not alive.any():
                break
            mine = alive[slot]
            offset = int(np.argmax(alive))
            sums = histograms(bins[mine], gradient[mine], curvature[mine], slot[mine] - offset, int(alive.sum()))
            place_splits(trees, tree, open_nodes[alive], best_splits(sums, p), p)
            at = trees.node_of(tree, bins, level + 1)
        margin += trees.value[tree, at]
    return trees


TREES = "model string, n_train bigint, trees binary"


def fit_boosted(table: FoldTable, p: BoostParams = BoostParams(), task_cells: int = TASK_CELLS,
                rows: DataFrame | None = None) -> DataFrame:
    """Written (model, n_train, trees) of every model of ``table``; ``rows`` are its ``binned`` rows."""
    rows = binned(table) if rows is None else rows
    small = F.col("n_train") * F.col("width") <= task_cells
    sizes = table.scales.select("group", "fold", "model", "n_train", F.size("center").alias("width"))
    parts = [_fit_in_tasks(rows, sizes.filter(small), p)]
    large = sizes.filter(~small).collect()
    if large:
        parts.append(_fit_by_passes(rows, {(r.group, r.fold): (r.model, r.n_train) for r in large}, p))
    return materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "boosted_trees")


def _folds_of(rows: DataFrame, role: str) -> DataFrame:
    """Binned rows of one role, once per fold."""
    low, high = (F.col(c) for c in RANGES[role])
    return rows.filter(low <= high).withColumn("fold", F.explode(F.sequence(low, high)))


def _fit_in_tasks(rows: DataFrame, sizes: DataFrame, p: BoostParams) -> DataFrame:
    """Each model's rows meet in one task; every model is of a checked size."""
    # one row per model
    mine = _folds_of(rows, TRAIN).join(F.broadcast(sizes.select("group", "fold", "model")), ["group", "fold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, (bins, y) in _by_model(batches, ("bins", "y")):
            codes = np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), -1)
            # rows in one order, however they came, so that sums have one rounding
            order = np.lexsort((np.array(y), *codes.T))
            yield pa.RecordBatch.from_pylist([{"model": model, "n_train": len(y), "trees": grow(codes[order], np.array(y)[order], p).pack()}],
                                             pa.schema([("model", pa.string()), ("n_train", pa.int64()), ("trees", pa.binary())]))

    return mine.select("model", "bins", "y").repartition("model").sortWithinPartitions("model").mapInArrow(run, TREES)


def _by_model(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[str, list[list]]]:
    """Columns of each model from a stream that is sorted by model."""
    held: list[list] = [[] for _ in columns]
    current = None
    for batch in batches:
        models = batch.column("model").to_pylist()
        values = [batch.column(c).to_pylist() for c in columns]
        for k, model in enumerate(models):
            if model != current and current is not None:
                yield current, held
                held = [[] for _ in columns]
            current = model
            for into, from_ in zip(held, values):
                into.append(from_[k])
    if current is not None:
        yield current, held


SUMS = "model string, node int, part binary"
SPLITS = "model string, node int, feature int, cut int, gain double, sums array<double>"


def _fit_by_passes(rows: DataFrame, models: dict[tuple[str, int], tuple[str, int]], p: BoostParams) -> DataFrame:
    """One pass over the rows per level of all trees; margins are written every ``PENDING`` trees."""
    spark = rows.sparkSession
    forests = {model: Trees.empty(p.trees, p.depth) for model, _ in models.values()}
    wanted = sorted({group for group, _ in models})
    table = (_folds_of(rows, TRAIN).filter(F.col("group").isin(wanted)).groupBy("group", "fold", "bins", "y")
             .agg(F.count(F.lit(1)).alias("n"))  # equal rows have equal margins for ever
             .withColumn("margin", F.lit(0.0)))
    names = {key: model for key, (model, _) in models.items()}
    table = materialize(table.filter(_named("group", "fold", names)), "margins")
    for tree in range(p.trees):
        if tree and tree % PENDING == 0:
            table = materialize(_with_margins(table, names, forests, tree - PENDING, tree), "margins")
        for level in range(p.depth):
            since = tree // PENDING * PENDING
            shared = spark.sparkContext.broadcast((names, forests, since, tree, level))
            sums = table.mapInArrow(_level_sums(shared), SUMS)
            splits = sums.repartition("model", "node").sortWithinPartitions("model", "node").mapInArrow(_level_splits(p), SPLITS)
            found = splits.collect()  # one row per node of the level
            shared.destroy()
            for r in found:
                s = np.array(r.sums).reshape(3, 2, 1)
                place_splits(forests[r.model], tree, np.array([r.node]), {
                    "feature": np.array([r.feature]), "cut": np.array([r.cut]), "gain": np.array([r.gain]),
                    "left": s[0], "right": s[1], "total": s[2]}, p)
            if not any(r.feature >= 0 for r in found):
                break
    sizes = dict(models.values())
    return spark.createDataFrame([(m, sizes[m], bytearray(t.pack())) for m, t in forests.items()], TREES)


def _named(group: str, fold: str, names: dict[tuple[str, int], str]):
    """Rows of the given (group, fold) pairs."""
    pairs = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(f).alias("f")) for g, f in sorted(names)])
    return F.array_contains(pairs, F.struct(F.col(group).alias("g"), F.col(fold).cast("int").alias("f")))


def _models_in(batch: pa.RecordBatch, names: dict[tuple[str, int], str]):
    """(model, places, bins) of the models of a batch."""
    keys = np.array([names[g, f] for g, f in zip(batch.column("group").to_pylist(), batch.column("fold").to_pylist())], object)
    bins = batch.column("bins").to_pylist()
    for model in sorted(set(keys.tolist())):
        mine = np.flatnonzero(keys == model)
        yield model, mine, np.frombuffer(b"".join(bins[k] for k in mine), np.uint8).reshape(len(mine), -1)


def _with_margins(table: DataFrame, names, forests: dict[str, Trees], first: int, last: int) -> DataFrame:
    """The table with the margins of further trees added."""
    shared = table.sparkSession.sparkContext.broadcast((names, forests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trees = shared.value
        for batch in batches:
            margin = batch.column("margin").to_numpy().copy()
            for model, mine, bins in _models_in(batch, known):
                margin[mine] += trees[model].margin(bins, first, last)
            yield batch.drop_columns(["margin"]).append_column("margin", pa.array(margin))

    return table.mapInArrow(run, table.schema)


def _level_sums(shared):
    """Arrow mapper: histograms of the nodes of one level, per model and node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, forests, since, tree, level = shared.value
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            y, n, margin = (batch.column(c).to_numpy() for c in ("y", "n", "margin"))
            for model, mine, bins in _models_in(batch, names):
                trees = forests[model]
                at = trees.node_of(tree, bins, level)
                open_rows = at >= 2**level - 1
                if not open_rows.any():
                    continue
                rows = mine[open_rows]
                g, h = slopes(y[rows], margin[rows] + trees.margin(bins[open_rows], since, tree))
                nodes, slot = np.unique(at[open_rows], return_inverse=True)
                sums = histograms(bins[open_rows], g * n[rows], h * n[rows], slot, len(nodes))
                for k, node in enumerate(nodes.tolist()):
                    key = (model, node)
                    totals[key] = totals[key] + sums[:, k] if key in totals else sums[:, k].copy()
        for (model, node), part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([node], pa.int32()), pa.array([part.tobytes()])],
                                             names=["model", "node", "part"])
    return run


def _level_splits(p: BoostParams):
    """Arrow mapper over sums that are sorted by model and node: the split of each node."""
    def chosen(key: tuple[str, int], total: np.ndarray) -> dict:
        best = best_splits(total.reshape(2, 1, -1, BINS), p)
        sums = np.concatenate([best["left"][:, 0], best["right"][:, 0], best["total"][:, 0]])
        return {"model": key[0], "node": key[1], "feature": int(best["feature"][0]), "cut": int(best["cut"][0]),
                "gain": float(best["gain"][0]), "sums": sums.tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("model", pa.string()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()),
                            ("gain", pa.float64()), ("sums", pa.list_(pa.float64()))])
        key, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(row["part"])
                if key == (row["model"], row["node"]):
                    total = total + part
                    continue
                if key:
                    yield pa.RecordBatch.from_pylist([chosen(key, total)], schema)
                key, total = (row["model"], row["node"]), part
        if key:
            yield pa.RecordBatch.from_pylist([chosen(key, total)], schema)

    return run


def trees_in_turns(fitted: DataFrame, limit: int = BROADCAST_BYTES) -> Iterator[dict[str, Trees]]:
    """The trees of all models, as many at a time as may go out to every task."""
    sizes = fitted.select("model", F.length("trees").alias("n")).orderBy("model").collect()
    turn: list[str] = []
    held = 0
    for k, r in enumerate(sizes):
        turn.append(r.model)
        held += r.n
        if held >= limit or k + 1 == len(sizes):
            picked = fitted.filter(F.col("model").isin(turn)).collect()
            yield {r.model: Trees.unpack(r.trees) for r in picked}
            turn, held = [], 0


def scored_rows(table: FoldTable, fitted: DataFrame, rows: DataFrame, score, added: str) -> DataFrame:
    """Test rows, once per fold, with the columns ``added`` that ``score(trees, bins)`` gives as arrays."""
    spark: SparkSession = rows.sparkSession
    models = F.broadcast(table.scales.select("group", "fold", "model"))
    test = _folds_of(rows, TEST).join(models, ["group", "fold"]).drop("group")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema if f.name != "bins")
    parts = []
    for trees in trees_in_turns(fitted):
        shared = spark.sparkContext.broadcast(trees)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = np.array(batch.column("model").to_pylist(), object)
                bins = batch.column("bins").to_pylist()
                for model in sorted(set(names.tolist())):
                    mine = np.flatnonzero(names == model)
                    codes = np.frombuffer(b"".join(bins[k] for k in mine), np.uint8).reshape(len(mine), -1)
                    some = batch.drop_columns(["bins"]).take(pa.array(mine))
                    new = score(shared.value[model], codes)
                    yield pa.RecordBatch.from_arrays([*some.columns, *new.values()], names=[*some.schema.names, *new])

        mine = test.filter(F.col("model").isin(list(trees)))
        parts.append(mine.mapInArrow(run, f"{kinds}, {added}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def predict_boosted(table: FoldTable, fitted: DataFrame, rows: DataFrame) -> DataFrame:
    """Test rows with ``margin``, ``proba`` and ``y_pred`` of their fold's model."""
    scored = scored_rows(table, fitted, rows, lambda trees, bins: {"margin": pa.array(trees.margin(bins))}, "margin double")
    return scored.withColumns({"proba": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))),
                               "y_pred": (F.col("margin") > 0).cast("int")})


def boosted_importance(fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """(model, feature, importance): share of the gain of all splits; 0 for all if there is none."""
    names = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, data in zip(batch.column("model").to_pylist(), batch.column("trees").to_pylist()):
                trees = Trees.unpack(data)
                used = trees.feature >= 0
                gains = np.bincount(trees.feature[used], trees.gain[used], len(names))
                share = gains / gains.sum() if gains.sum() else gains
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(names)), pa.array(names), pa.array(share)],
                                                 names=["model", "feature", "importance"])

    return fitted.select("model", "trees").mapInArrow(run, "model string, feature string, importance double")
