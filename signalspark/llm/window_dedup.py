"""Exact substring dedup: radix passes over the repeated windows of a fixed length.

A suffix matters through its first ``window`` bytes only, so sorting stops at that
depth and equal groups are exactly the repeated windows. The digits, most
significant first, are

1. the window's anchor: its 32-byte string with the smallest hash (leftmost if tied),
2. the anchor's offset and the remaining bytes, as one 64-bit fingerprint.

The first digit is the same for runs of some 35 neighbouring windows, so the first
pass moves one row per run; a run whose anchor occurs once has no repeated window
and goes no further. Runs that remain are dealt by anchor with their bytes, and each
task finishes its groups by sorting fingerprints; the earliest window of a group
stays. An anchor that many documents share (found in a sample, which only splits
the work) skips to the last digit: its windows are grouped by fingerprint with
partial aggregation. Texts equal to an earlier document's are settled beforehand.

Earlier means a smaller id, or an earlier start in the same document. Null ids
sort first; rows that share an id are ordered by text digest, and rows that repeat
id and text count as one document. Null and short texts lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.words import BYTE_CODES, INVERSE, ODD, Piece, mix, pieces, powers, signed
from signalspark.storage import materialize

WINDOW = 100
ANCHOR = 32
#: Documents that are sampled for hot anchors, and how many of them make one hot.
SAMPLE_DOCS = 10_000
HOT_DOCS = 8
#: Runs that a task sorts together.
BATCH_RUNS = 20_000
NO_ID = -(1 << 63)
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


def fingerprints(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` bytes, by start."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(ODD, n)[:n], out=sums[1:])
    return mix((sums[length:] - sums[:n - length + 1]) * powers(INVERSE, n)[:n - length + 1])


def sliding_min(x: np.ndarray, length: int) -> np.ndarray:
    """Minimum of every ``length`` neighbours, by doubling."""
    span = 1
    while span * 2 <= length:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = length - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def runs(piece: Piece, window: int = WINDOW, anchor: int = ANCHOR):
    """Runs of windows with one anchor: (text, first start, last start, anchor place, anchor hash)."""
    n = len(piece.data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64)
    grams = fingerprints(piece.data, anchor)
    place = np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min((grams & HIGH) | place, window - anchor + 1) & LOW).astype(np.int64)
    edges = np.zeros(n + 2, np.int8)
    long = np.diff(piece.bounds) >= window
    edges[piece.bounds[:-1][long]] += 1
    edges[piece.bounds[1:][long] - window + 1] -= 1
    inside = np.cumsum(edges[:len(at)]) > 0
    same = inside[1:] & inside[:-1] & (at[1:] == at[:-1])
    first = np.flatnonzero(inside & ~np.concatenate([[False], same]))
    last = np.flatnonzero(inside & ~np.concatenate([same, [False]]))
    return np.searchsorted(piece.bounds, first, "right") - 1, first, last, at[first], grams[at[first]]


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("id").to_numpy(zero_copy_only=False), batch.column("sub").to_numpy(zero_copy_only=False)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text compressed: it is what the shuffle of the texts mostly holds."""
    for batch in batches:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        texts = pa.array([squeeze(t.as_py().encode()) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), texts], names=["id", "digest", "text"])


def unpacked(batch: pa.RecordBatch) -> pa.Array:
    """Texts of a batch as bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t.as_py()) for t in batch.column("text")], pa.binary())


def _anchor_rows(hot: np.ndarray):
    """(anchor, id, sub, place) of every run whose anchor is not hot."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = _ids(batch)
            for piece in pieces(unpacked(batch)):
                text, _, _, at, gram = runs(piece)
                keep = ~_among(gram, hot)
                text, at, gram = text[keep], at[keep], gram[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(gram)), pa.array(ids[piece.first_row + text]),
                     pa.array(subs[piece.first_row + text]), pa.array((at - piece.bounds[text]).astype(np.int32))],
                    names=["anchor", "id", "sub", "place"])
    return step


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, sub, start, bytes) of the runs that a row's ``places`` name."""
    for batch in batches:
        ids, subs = _ids(batch)
        lists = batch.column("places")
        row_of = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        named = np.sort((row_of.astype(np.int64) << 32) | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        for piece in pieces(unpacked(batch)):
            text, first, last, at, gram = runs(piece)
            row = piece.first_row + text
            keep = np.flatnonzero(_among((row << 32) | (at - piece.bounds[text]), named))
            content = [piece.data[a:b].tobytes() for a, b in zip(first[keep], last[keep] + WINDOW, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(gram[keep])), pa.array(ids[row[keep]]), pa.array(subs[row[keep]]),
                 pa.array((first[keep] - piece.bounds[text[keep]]).astype(np.int32)), pa.array(content, pa.binary())],
                names=["anchor", "id", "sub", "start", "bytes"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed byte spans of runs that come sorted by (anchor, id, sub, start)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < BATCH_RUNS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchors = table.column("anchor").chunk(0).to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1]))
        if cut:
            yield _spans(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if rows:
        yield _spans(pa.Table.from_batches(held))


def _spans(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    place_of = [table.column(c).chunk(0).to_numpy() for c in ("anchor", "id", "sub", "start")]
    # rows that repeat id and text come as equal neighbours
    fresh = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in place_of], axis=0)])
    if not fresh.all():
        table = table.filter(pa.array(fresh)).combine_chunks()
    col = {c: table.column(c).chunk(0) for c in table.column_names}
    anchors, starts = col["anchor"].to_numpy(), col["start"].to_numpy().astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    run_no, place, prints = [], [], []
    for piece in pieces(col["bytes"]):
        p = fingerprints(piece.data, WINDOW)
        n = np.diff(piece.bounds) - WINDOW + 1
        no = np.repeat(np.arange(piece.n), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run_no.append(no + piece.first_row)
        place.append(within)
        prints.append(p[piece.bounds[no] + within])
    no, within, key = np.concatenate(run_no), np.concatenate(place), np.concatenate(prints)
    # equal anchors are neighbours, so rows that tie in the print are compared in reading order
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_anchor = key[order], anchors[no[order]]
    again = np.zeros(len(key), bool)
    again[order[1:]] = (sorted_key[1:] == sorted_key[:-1]) & (sorted_anchor[1:] == sorted_anchor[:-1])
    hit = np.flatnonzero(again)
    if len(hit):
        new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(no[hit]) > 0)])
        a, b = hit[new], hit[np.concatenate([new[1:], [True]])]
        found.append((no[a], starts[no[a]] + within[a], starts[no[b]] + within[b] + WINDOW))
    rows = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [col["id"].take(pa.array(rows)), col["sub"].take(pa.array(rows)),
         pa.array((found[0][1] if found else rows).astype(np.int32)),
         pa.array((found[0][2] if found else rows).astype(np.int32))], names=["id", "sub", "from", "to"])


def _hot_windows(hot: np.ndarray):
    """(print, id, sub, start) of every window of a hot anchor, the earliest of a piece's equals only once as ``first``."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = _ids(batch)
            for piece in pieces(unpacked(batch)):
                text, first, last, _, gram = runs(piece)
                keep = _among(gram, hot)
                text, first, n = text[keep], first[keep], (last - first + 1)[keep]
                no = np.repeat(np.arange(len(n)), n)
                start = first[no] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                prints = fingerprints(piece.data, WINDOW)[start] if len(start) else np.zeros(0, np.uint64)
                row = piece.first_row + text[no]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(prints)), pa.array(ids[row]), pa.array(subs[row]),
                     pa.array((start - piece.bounds[text[no]]).astype(np.int32))],
                    names=["print", "id", "sub", "start"])
    return step


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept bytes and counts of each document, from its ``spans``."""
    for batch in batches:
        texts, copies = unpacked(batch), batch.column("is_copy").to_pylist()
        out = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            raw = texts[i].as_py()
            if copies[i] and len(raw) >= WINDOW:
                spans = [{"from": 0, "to": len(raw)}]
            kept, at, gone = [], 0, []
            for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
                if gone and a <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], b)
                else:
                    gone.append([a, b])
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(rest), len(gone), [v for g in gone for v in g],
                        hashlib.sha256(rest).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.string())],
            names=["id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])


def hot_anchors(base: DataFrame) -> np.ndarray:
    """Sorted anchors that many of some sampled documents share; at most a few hundred thousand."""
    n = base.count()
    sampled = base.sample(min(1.0, SAMPLE_DOCS / max(n, 1)), seed=7).dropDuplicates(["digest"])
    packed = sampled.mapInArrow(_pack, "id long, digest long, text binary")
    rows = packed.withColumn("sub", F.lit(0)).select("id", "sub", "text").mapInArrow(
        _anchor_rows(np.zeros(0, np.uint64)), "anchor long, id long, sub int, place int")
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_DOCS).select("anchor")
    return np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, removed, kept_sha256) per row of ``docs``; removed lists start and end bytes in turn."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))
    rows = base.select("id", "digest").distinct()
    first = rows.groupBy("digest").agg(F.min("id").alias("first_id"))
    by_id = Window.partitionBy("id").orderBy("digest")
    flags = materialize(rows.withColumn("sub", (F.row_number().over(by_id) - 1).cast("int")).join(first, "digest")
                        .select("id", "digest", "sub", (F.col("first_id") < F.col("id")).alias("is_copy")), "flags")
    hot = hot_anchors(base)
    # one exchange of the texts serves all three passes below
    packed = base.select("id", "digest", "text").mapInArrow(_pack, "id long, digest long, text binary")
    dealt = packed.repartition("id", "digest").join(flags.hint("shuffle_hash"), ["id", "digest"])
    originals = dealt.filter(~F.col("is_copy")).select("id", "digest", "sub", "text")
    slim = originals.select("id", "sub", "text")
    keys = flags.select("id", "sub", "digest")  # back to the key by which texts are dealt
    anchors = slim.mapInArrow(_anchor_rows(hot), "anchor long, id long, sub int, place int")
    tied = (anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).filter(F.col("n") > 1)
            .groupBy("id", "sub").agg(F.collect_list("place").alias("places")).join(keys, ["id", "sub"]))
    todo = originals.join(tied.drop("sub"), ["id", "digest"]).select("id", "sub", "text", "places")
    spans = (todo.mapInArrow(_run_rows, "anchor long, id long, sub int, start int, bytes binary")
             .repartition("anchor").sortWithinPartitions("anchor", "id", "sub", "start")
             .mapInArrow(_finish, "id long, sub int, from int, to int"))
    if len(hot):
        windows = slim.mapInArrow(_hot_windows(hot), "print long, id long, sub int, start int")
        firsts = (windows.groupBy("print").agg(F.min(F.struct("id", "sub", "start")).alias("first"),
                                               F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
        later = windows.join(firsts, "print").filter(F.struct("id", "sub", "start") > F.col("first"))
        spans = spans.unionByName(later.select("id", "sub", F.col("start").alias("from"),
                                               (F.col("start") + WINDOW).alias("to")))
    listed = spans.groupBy("id", "sub").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    listed = listed.join(keys, ["id", "sub"]).drop("sub")
    whole = dealt.join(listed, ["id", "digest"], "left").select("id", "text", "is_copy", "spans")
    done = whole.mapInArrow(_removed, "id long, n_bytes long, n_removed long, n_spans long, "
                                      "removed array<int>, kept_sha256 string")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans",
                       "removed", "kept_sha256")
