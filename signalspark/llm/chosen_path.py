"""N-gram Jaccard join by chosen paths: all pairs of texts with similarity 0.8 or more.

Sets are the five-word shingles of a text. A set is embedded as ``COORDINATES``
min-hash values, tokens that two sets share with the probability of their
similarity. A run splits all sets by a sampled coordinate, each part by coordinates
sampled for that part, and so on ``LEVELS`` times, ``1 / threshold`` coordinates per
step on average; a part that is small enough is not split further. Two sets at the
threshold meet in a run with probability ``meeting_chance``; ``runs_for`` gives the
number of independent runs that brings the recall to its target.

Members of a part are compared by their embeddings, and pairs that may be similar
are joined to candidate components. Within each of them all pairs are compared
exactly, block against block, so links that the paths missed inside a component
are found as well. Links are counted, never emitted as pairs.

Texts of one to four words have one shingle; empty and null texts link with
nothing. Equal texts are one class with a weight and link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.components import connected_components
from signalspark.llm.streams import spread_labels, whole_groups
from signalspark.llm.words import ODD, mix, pieces, shingles_of, signed, text_starts, words_of
from signalspark.storage import materialize

SIMILARITY = 0.8
SHINGLE = 5
COORDINATES = 64
LEVELS = 3
RECALL = 0.995
#: Parts of up to this many sets are brute-forced.
SMALL = 64
#: Larger parts that no level splits are cut into blocks of this size, larger components too.
BLOCK = 512
#: Embeddings of a pair at the threshold agree in fewer coordinates with a chance below 1 in 1000.
AGREE = 0.64


def meeting_chance(threshold: float = SIMILARITY, levels: int = LEVELS) -> float:
    """Chance that a pair at the threshold shares a path of full depth in one run."""
    extra = 1 / threshold - 1
    chance = 1.0
    for _ in range(levels):
        # one coordinate always, a second with probability ``extra``
        hit = threshold * chance
        chance = 1 - (1 - hit) * (1 - extra * hit)
    return chance


def runs_for(recall: float = RECALL, threshold: float = SIMILARITY) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(threshold)))


#: Odd factors: the order of ``hash * factor`` is another one for each coordinate, so that the samples of small
#: sets do not depend on each other.
FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(ODD)) | np.uint64(1)


def embeddings(sh, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, COORDINATES values of 32 bits) of each text with shingles."""
    starts = text_starts(sh.text, texts)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if not len(some):
        return some, np.zeros((0, COORDINATES), np.uint32)
    at = starts[:-1][some]
    out = np.empty((len(some), COORDINATES), np.uint32)
    for i, factor in enumerate(FACTORS):
        out[:, i] = mix(np.minimum.reduceat(sh.hash * factor, at)) & np.uint64(0xFFFFFFFF)
    return some, out


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            some, values = embeddings(shingles_of(words_of(piece), SHINGLE), piece.n)
            rows = pa.array(piece.first_row + some)
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").take(rows), batch.column("id").take(rows),
                 pa.array([v.tobytes() for v in values], pa.binary())], names=["digest", "id", "embedding"])


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def paths(values: np.ndarray, runs: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(row, node of every level) of all paths of all runs."""
    rows_out, nodes_out = [], []
    extra = np.uint64(int((1 / SIMILARITY - 1) * 2 ** 32))
    for run in range(runs):
        row = np.arange(len(values))
        node = np.full(len(values), mix(np.array([run + 1], np.uint64) * np.uint64(ODD))[0])
        trail: list[np.ndarray] = []
        for _ in range(levels):
            pick = mix(node + np.uint64(1))
            second = (pick >> np.uint64(32)) < extra
            both = np.concatenate([np.arange(len(row)), np.flatnonzero(second)])
            draw = np.concatenate([pick, mix(pick[second])])
            coordinate = (draw % np.uint64(COORDINATES)).astype(np.int64)
            row, parent = row[both], node[both]
            token = values[row, coordinate].astype(np.uint64) | (coordinate.astype(np.uint64) << np.uint64(32))
            node = mix(parent * np.uint64(ODD) + mix(token))
            trail = [t[both] for t in trail] + [node]
        rows_out.append(row)
        nodes_out.append(np.stack(trail, axis=1))
    return np.concatenate(rows_out), np.concatenate(nodes_out)


def _paths(runs: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("digest").to_numpy()
            for start in range(0, len(batch), 4096):
                values = _values(batch.column("embedding").slice(start, 4096))
                row, nodes = paths(values, runs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[start + row]), *[pa.array(signed(np.ascontiguousarray(nodes[:, k]))) for k in range(LEVELS)]],
                    names=["digest", *[f"node{k}" for k in range(LEVELS)]])
    return step


def leaves(walked: DataFrame, small: int = SMALL) -> DataFrame:
    """(leaf, digest, size): each path down to its first small part, parts of one set left out."""
    out, rest = [], walked
    for k in range(LEVELS):
        sizes = rest.select(f"node{k}", "digest").distinct().groupBy(f"node{k}").agg(F.count(F.lit(1)).alias("size"))
        sized = materialize(rest.join(sizes.filter("size > 1"), f"node{k}"), "parts")
        last = k == LEVELS - 1
        done = sized if last else sized.filter(F.col("size") <= small)
        out.append(done.select(F.col(f"node{k}").alias("leaf"), "digest", "size").distinct())
        rest = sized.filter(F.col("size") > small).drop("size")
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def blocked(df: DataFrame, key: str, size: str, member: str, block: int = BLOCK) -> DataFrame:
    """Rows once per meeting of their group's blocks: ``bucket`` holds two blocks, or all of a small group.

    ``own`` is the row's block, ``pair`` the two blocks (equal for a block with itself).
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(block)), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1),
                        lambda o: F.struct(F.least(F.col("own"), o).alias("low"), F.greatest(F.col("own"), o).alias("high")))
    return (df.withColumns({"own": own, "_blocks": blocks}).withColumn("pair", F.explode(meets)).drop("_blocks")
            .withColumn("bucket", F.xxhash64(key, "pair.low", "pair.high", F.lit(block))))


def _near_embeddings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One edge to the smallest digest that agrees, per member of a part."""
    need = math.ceil(AGREE * COORDINATES)
    for batch in whole_groups(batches, "bucket"):
        bucket, digest = batch.column("bucket").to_numpy(), batch.column("digest").to_numpy()
        values = _values(batch.column("embedding"))
        a_all, b_all = [], []
        at, step = np.arange(len(bucket)), 1
        while True:
            at = at[at + step < len(bucket)]
            at = at[bucket[at] == bucket[at + step]]
            if not len(at):
                break
            for s in range(0, len(at), 1 << 15):
                a = at[s:s + (1 << 15)]
                near = a[(values[a] == values[a + step]).sum(axis=1) >= need]
                a_all.append(near)
                b_all.append(near + step)
            step += 1
        a = np.concatenate(a_all) if a_all else np.zeros(0, np.int64)
        b = np.concatenate(b_all) if b_all else a
        root = spread_labels(digest, a, b)
        hit = root != digest
        yield pa.RecordBatch.from_arrays([pa.array(digest[hit]), pa.array(root[hit])], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text replaced by its sorted different shingles."""
    for batch in batches:
        keep = [c for c in batch.schema.names if c != "text"]
        for piece in pieces(batch.column("text")):
            sh = shingles_of(words_of(piece), SHINGLE)
            starts = text_starts(sh.text, piece.n)
            sets = [np.unique(sh.hash[starts[i]:starts[i + 1]]).tobytes() for i in range(piece.n)]
            rows = batch.slice(piece.first_row, piece.n)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(sets, pa.binary())],
                                             names=[*keep, "shingles"])


def common_counts(sets: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other."""
    same = other is None
    every = sets if same else sets + other
    token, of = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    often = np.bincount(of, minlength=len(token)) > 1  # a token of one set is in no intersection
    place = np.cumsum(often) - 1
    use = often[of]
    column, row = place[of[use]], row[use]
    n = len(sets)
    out = np.zeros((n, len(every) - (0 if same else n)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = max(64, (1 << 22) // max(len(every), 1))
    for start in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(every), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - start] = 1
        out += dense[:n] @ (dense if same else dense[n:]).T
    return np.rint(out).astype(np.int64)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n, root): links of each text in one meeting of blocks and the smallest text it reaches."""
    for batch in whole_groups(batches, "bucket", 2048):
        bucket, digest = batch.column("bucket").to_numpy(), batch.column("digest").to_numpy()
        again = np.flatnonzero((bucket[1:] == bucket[:-1]) & (digest[1:] == digest[:-1])) + 1
        if len(again):  # rows that repeat id and text
            batch = batch.take(pa.array(np.delete(np.arange(len(batch)), again)))
            bucket, digest = batch.column("bucket").to_numpy(), batch.column("digest").to_numpy()
        own, low = batch.column("own").to_numpy(), batch.column("low").to_numpy()
        high, weight = batch.column("high").to_numpy(), batch.column("weight").to_numpy()
        shingles = batch.column("shingles")
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if end - start < 2:
                continue
            sets = [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in range(start, end)]
            inner = low[start] == high[start]
            first = np.arange(end - start) if inner else np.flatnonzero(own[start:end] == low[start])
            second = first if inner else np.flatnonzero(own[start:end] == high[start])
            if not len(first) or not len(second):
                continue
            size = np.array([len(s) for s in sets])
            common = common_counts([sets[i] for i in first], None if inner else [sets[i] for i in second])
            union = size[first][:, None] + size[second][None, :] - common
            a, b = np.nonzero(10 * common >= 8 * union)  # Jaccard >= 0.8 in whole numbers
            if inner:
                a, b = a[a < b], b[a < b]
            a, b = first[a], second[b]
            n = np.bincount(a, weight[start:end][b], end - start) + np.bincount(b, weight[start:end][a], end - start)
            root = spread_labels(digest[start:end], a, b)
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(digest[start:end][hit]), pa.array(n[hit].astype(np.int64)),
                                              pa.array(root[hit])], names=["digest", "n", "root"])


def candidate_components(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(digest, component, size) of texts that the paths bring together with similar embeddings."""
    nodes = ", ".join(f"node{k} long" for k in range(LEVELS))
    walked = classes.select("digest", "embedding").mapInArrow(_paths(runs_for(recall)), f"digest long, {nodes}")
    found = materialize(leaves(walked), "leaves")
    parts = blocked(found, "leaf", "size", "digest").join(classes.select("digest", "embedding"), "digest")
    near = (parts.select("bucket", "digest", "embedding").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_near_embeddings, "a long, b long"))
    grouped = connected_components(near)
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return materialize(grouped.withColumnRenamed("node", "digest").join(sizes, "component"), "candidates")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL,
                 with_digest: bool = False) -> DataFrame:
    """(id, text_id, class_id, n_links) per row of ``docs``, also the text's digest if asked for.

    ``text_id`` is the smallest id with the same text, ``class_id`` the smallest id
    within reach over links, ``n_links`` the number of other rows that are linked.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))
    classes = materialize(base.mapInArrow(_embed, "digest long, id long, embedding binary").groupBy("digest").agg(
        F.min("id").alias("text_id"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding")), "classes")
    members = candidate_components(classes, recall).join(classes.select("digest", "text_id", "weight"), "digest")
    # one row of each class brings the text
    texts = (base.join(members, "digest").filter(F.col("id").eqNullSafe(F.col("text_id")))
             .select("digest", "component", "size", "weight", "text").mapInArrow(
                 _sets, "digest long, component long, size long, weight long, shingles binary"))
    met = blocked(texts, "component", "size", "digest").select(
        "bucket", "own", "pair.low", "pair.high", "digest", "weight", "shingles")
    linked = materialize(met.repartition("bucket").sortWithinPartitions("bucket", "digest")
                         .mapInArrow(_exact, "digest long, n long, root long"), "links")
    groups = connected_components(linked.select("digest", "root"), "digest", "root").withColumnRenamed("node", "digest")
    counts = linked.groupBy("digest").agg(F.sum("n").alias("n"))
    labelled = classes.select("digest", "text_id", "weight").join(groups, "digest", "left").join(counts, "digest", "left")
    smallest = labelled.filter("component is not null").groupBy("component").agg(F.min("text_id").alias("class_id"))
    labelled = labelled.join(smallest, "component", "left").select(
        "digest", "text_id", F.coalesce("class_id", "text_id").alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = base.select("id", "digest").join(labelled, "digest", "left")
    digest = ["digest"] if with_digest else []
    return out.select(F.col("id").alias(id_col), *digest, F.coalesce("text_id", "id").alias("text_id"),
                      F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
