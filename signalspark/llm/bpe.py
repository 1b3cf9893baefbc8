"""Byte-level BPE: a global shuffle of distinct words encodes each of them once.

1. The most frequent words of some sampled documents are encoded by a Spark job and
   handed to every task; number and length of these words are fixed. They are what
   would make a shuffle by word uneven. The sample only splits the work.
2. All other words of all documents are exploded with their positions and dealt by
   word. Equal words come together and are encoded once; ids go back to document
   and position.
3. Documents, whose texts travel compressed, are put together by position.
4. Decoding looks every id up in the table of token bytes.

The ranks are a file in tiktoken's format, named by a parameter and read on the
driver; it has one row per token. Matches of the pattern are encoded separately and
no special tokens are known. A null text is empty; the rows that repeat id and text
are encoded alike; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.storage import materialize

SAMPLE_DOCS = 20_000
COMMON_WORDS, COMMON_BYTES = 1 << 18, 32
#: Longer words that are handed out, and their length; above it a word is encoded once per document.
LONG_WORDS, LONG_BYTES = 1000, 4096
#: Sampled texts, characters of each and bytes of the compressor's dictionary, and its level; results do not depend on them.
PHRASE_DOCS, PHRASE_CHARS, PHRASE_BYTES, PACK_LEVEL = 4000, 8192, 1 << 19, 6
NO_ID = -(1 << 63)
#: Words that a task holds before it hands them on.
HELD_WORDS = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (t.as_py() or "" for t in batch.column("text"))


def _count(pattern: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for text in _texts(batch):
                held.update(split(text))
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)
    return step


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                      names=["word", "n"])


def _coder(ranks: dict[bytes, int], pattern: str):
    import tiktoken
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    kind = _id_kind(max(ranks.values(), default=-1) + 1)
    # a word is one match of the pattern, alone as in its text
    return lambda word: np.array(encode(word), kind).tobytes()


def _id_kind(size: int) -> str:
    """Ids of words on their way: two bytes if all ``size`` tokens fit."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _encode(ranks, pattern: str):
    """(word, ids) of distinct words."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(ranks.value, pattern)
        for batch in batches:
            out = [code(word) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.binary())], names=["word", "ids"])
    return step


def _encode_placed(ranks, pattern: str):
    """(id, digest, part) of placed words: four bytes of position, then the ids."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last, ids = _coder(ranks.value, pattern), None, b""
        for batch in batches:
            out = []
            for word, place in zip(batch.column("word").to_pylist(), batch.column("place").to_pylist(), strict=True):
                if word != last:
                    last, ids = word, code(word)
                out.append(place.to_bytes(4, "little") + ids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(out, pa.binary())],
                                             names=["id", "digest", "part"])
    return step


def _pack(phrases):
    """Rows with their text compressed, for the shuffle."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=PACK_LEVEL, dict_data=_dictionary(phrases.value)).compress
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "text"]
            texts = pa.array([squeeze((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts], names=[*keep, "text"])
    return step


def _dictionary(phrases: bytes) -> zstandard.ZstdCompressionDict | None:
    if not phrases:
        return None
    found = zstandard.ZstdCompressionDict(phrases)
    found.precompute_compress(level=PACK_LEVEL)
    return found


def common_phrases(base: DataFrame) -> bytes:
    """A dictionary for the compressor, from the heads of some sampled texts; empty if they are too few or too short."""
    sampled = base.sample(min(1.0, PHRASE_DOCS / max(base.count(), 1)), seed=7)
    heads = sampled.select(F.substring("text", 1, PHRASE_CHARS).alias("text")).limit(2 * PHRASE_DOCS).toArrow()
    try:
        return zstandard.train_dictionary(PHRASE_BYTES, [h.encode() for h in heads.column("text").to_pylist()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _rare(common, pattern: str):
    """(id, digest, place, word) of the words that are not common."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = regex.compile(pattern).findall, common.value
        for batch in batches:
            ids, digests = batch.column("id"), batch.column("digest")
            rows, places, words = [], [], []
            for row, text in enumerate(_texts(batch)):
                found = [(i, w) for i, w in enumerate(split(text)) if w not in known]
                rows += [row] * len(found)
                places += [i for i, _ in found]
                words += [w for _, w in found]
                if len(rows) > HELD_WORDS or row + 1 == len(batch):
                    at = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), digests.take(at), pa.array(places, pa.int32()), pa.array(words, pa.string())],
                        names=["id", "digest", "place", "word"])
                    rows, places, words = [], [], []
    return step


def filled(words: list[str], known: dict[str, bytes], rare: list[bytes] | None, code) -> bytes:
    """Ids of the words of one text, with those that came back by place.

    Different texts of one id may share a digest and then get the parts of both. That shows
    in the places: if they are not those of the missing words, one part each, the words
    are encoded here.
    """
    parts = [known.get(w) for w in words]
    missing = [k for k, p in enumerate(parts) if p is None]
    back: dict[int, bytes] = {}
    clash = False
    for part in rare or ():
        at, ids = int.from_bytes(part[:4], "little"), part[4:]
        clash |= back.setdefault(at, ids) != ids
    clash |= len(back) != len(missing) or not all(k in back for k in missing)
    for k in missing:
        parts[k] = code(words[k]) if clash else back[k]
    return b"".join(parts)


def _assemble(common, pattern: str, tokens, ranks, phrases):
    """Ids of each document, common and rare words by position, and the bytes that they decode to."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = regex.compile(pattern).findall, common.value
        code = cache(lambda: _coder(ranks.value, pattern))
        table, ends = tokens.value
        kind = _id_kind(len(ends) - 1)
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(phrases.value)).decompress
        for batch in batches:
            all_ids, all_bytes = [], []
            rare = batch.column("rare")
            for row, packed in enumerate(batch.column("text")):
                text = unpack(packed.as_py()).decode()
                ids = np.frombuffer(filled(split(text), known, rare[row].as_py(), lambda word: code()(word)), kind).astype("<u4")
                all_ids.append(ids.tobytes())
                all_bytes.append(_decoded(ids, table, ends))
            keep = [c for c in batch.schema.names if c not in ("text", "rare")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(all_ids, pa.binary()), pa.array(all_bytes, pa.binary())],
                names=[*keep, "ids", "decoded"])
    return step


def _decoded(ids: np.ndarray, table: np.ndarray, ends: np.ndarray) -> bytes:
    """Token bytes of ids, one after the other."""
    size = ends[ids + 1] - ends[ids]
    total = int(size.sum())
    at = np.arange(total) - np.repeat(np.cumsum(size) - size - ends[ids], size)
    return table[at].tobytes()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, decoded = batch.column("ids"), batch.column("decoded")
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(i.as_buffer()) // 4 for i in ids], pa.int64()),
             pa.array([hashlib.sha256(i.as_buffer()).hexdigest() for i in ids], pa.string()),
             pa.array([hashlib.sha256(d.as_buffer()).hexdigest() for d in decoded], pa.string())],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def common_words(base: DataFrame, ranks, pattern: str) -> dict[str, bytes]:
    """Ids of the most frequent words of a sample, within fixed numbers and lengths."""
    sampled = base.sample(min(1.0, SAMPLE_DOCS / max(base.count(), 1)), seed=7)
    words = materialize(sampled.select("text").mapInArrow(_count(pattern), "word string, n long")
                        .groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = F.octet_length("word")
    top = (words.filter(size <= COMMON_BYTES).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).unionByName(
        words.filter((size > COMMON_BYTES) & (size <= LONG_BYTES)).orderBy(F.desc("n"), "word").limit(LONG_WORDS)))
    rows = top.mapInArrow(_encode(ranks, pattern), "word string, ids binary").toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) per row: token ids as little-endian 32-bit numbers and the bytes that they stand for."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast(ranks)
    common = spark.sparkContext.broadcast(common_words(base, shared, pattern))
    phrases = spark.sparkContext.broadcast(common_phrases(base))
    # rows without an id are mostly told apart by 32 bits, the few that repeat an id by 8, as the
    # digest is shuffled with every word; where they are not, ``filled`` sees it
    digest = F.hash("text")
    keyed = base.withColumn("digest", F.when(F.col("id") == NO_ID, digest).otherwise(digest.bitwiseAND(255)))
    rare = keyed.mapInArrow(_rare(common, pattern), "id long, digest int, place int, word string")
    apart = F.when(F.octet_length("word") > LONG_BYTES, F.col("digest"))
    back = (rare.repartition("word", apart).sortWithinPartitions("word")
            .mapInArrow(_encode_placed(shared, pattern), "id long, digest int, part binary"))
    # flat rows are smaller to shuffle than lists; documents are then dealt alike
    listed = back.repartition("id", "digest").groupBy("id", "digest").agg(F.collect_list("part").alias("rare"))
    packed = keyed.mapInArrow(_pack(phrases), "id long, digest int, text binary")
    whole = packed.join(listed, ["id", "digest"], "left")
    size = max(ranks.values(), default=-1) + 1
    by_id = [b""] * size
    for token, rank in ranks.items():
        by_id[rank] = token
    tokens = spark.sparkContext.broadcast((np.frombuffer(b"".join(by_id), np.uint8),
                                           np.concatenate([[0], np.cumsum([len(t) for t in by_id], dtype=np.int64)])))
    done = whole.select("id", "text", "rare").mapInArrow(
        _assemble(common, pattern, tokens, shared, phrases), "id long, ids binary, decoded binary")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "ids", "decoded")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    kind = coded.schema[id_col].dataType.simpleString()
    return coded.withColumnRenamed(id_col, "id").mapInArrow(
        _digests, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
