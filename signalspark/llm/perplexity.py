"""Quality rules: fixed text rules and n-gram perplexity bands per language.

All byte n-grams of all documents are counted, summed up in tasks and then by Spark.
A modified Kneser-Ney model per language follows from the counts by grouped
aggregates and joins. Scoring reads it as sorted arrays of 64-bit keys. Their size
follows the number of different n-grams, not of documents; it is checked, and a
model beyond ``MAX_MODEL_ROWS`` is joined to the documents' n-grams instead.

A document is rejected if a fixed rule fails or if its mean log perplexity lies
outside its language's band. The band is taken on the logarithm of that mean, which has
no lowest value, and on each side by itself: the median of all documents and ``BAND`` times
its distance to that side's quartile (wider by the square root of its shortness below
``FULL_WORDS``). Null texts are empty, null languages a language of their own;
texts shorter than an n-gram have no perplexity and only the fixed rules apply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalspark.llm.words import ODD, Piece, mix, pieces, range_hashes, shingles_of, signed, words_of
from signalspark.storage import materialize

ORDER = 4
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BAND = 7.0
#: From this many words on the band has its full narrowness; below, it widens with the noise of a short mean.
FULL_WORDS = 300
#: Least distance of a quartile from the median, in logarithms of the mean: a uniform corpus keeps its tails.
LEAST_SPREAD = 0.004
MAX_MODEL_ROWS = 8_000_000
#: Different n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 2_000_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def text_features(piece: Piece) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a piece."""
    words = words_of(piece)
    n, texts = len(piece.data), piece.n
    n_words = np.bincount(words.text, minlength=texts)
    edge = np.zeros(n + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    inside = np.cumsum(edge[:n]) > 0
    chars = _per_text(inside & ((piece.data & 0xC0) != 0x80), piece.bounds)
    symbols = _per_text(SYMBOLS[piece.data], piece.bounds)
    # lines: between line feeds, text starts and text ends
    feeds = np.flatnonzero(piece.data == 0x0A)
    some = piece.bounds[:-1] < piece.bounds[1:]
    starts = np.sort(np.concatenate([feeds + 1, piece.bounds[:-1][some]]))
    feed_text = np.searchsorted(piece.bounds[1:], feeds, "right")
    # a start after a text's last feed belongs to that text, also when nothing follows it
    of_text = np.sort(np.concatenate([feed_text, np.flatnonzero(some)]))
    ends = np.append(starts[1:], 0)
    last = np.append(of_text[1:] != of_text[:-1], True) if len(of_text) else np.zeros(0, bool)
    ends = np.where(last, piece.bounds[1:][of_text], ends - 1) if len(of_text) else ends[:0]
    sums = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    worded = sums[ends] > sums[starts]
    starts, ends, of_text = starts[worded], ends[worded], of_text[worded]
    line = range_hashes(piece.data, starts, ends)
    _, first = np.unique(mix(line + of_text.astype(np.uint64) * np.uint64(ODD)), return_index=True)
    dup_lines = np.bincount(of_text, minlength=texts) - np.bincount(of_text[first], minlength=texts)
    # words in shingles that a text has twice or more
    sh = shingles_of(words, 5, short=False)
    key = mix(sh.hash + sh.text.astype(np.uint64) * np.uint64(ODD))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.hash) + 6, np.int64)
    np.add.at(cover, sh.word[twice], 1)
    np.add.at(cover, sh.word[twice] + 5, -1)
    covered = np.cumsum(cover[:len(words.hash)]) > 0
    repeat = np.bincount(words.text[covered], minlength=texts)
    return [n_words, chars, symbols, dup_lines, repeat]


def grams(piece: Piece, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram as a number) of every place of a piece whose n-gram lies in one text."""
    data, n = piece.data, len(piece.data)
    if n < order:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n - order + 1, np.uint64)
    for j in range(order):
        value = (value << np.uint64(8)) | data[j:n - order + 1 + j].astype(np.uint64)
    text = np.repeat(np.arange(piece.n), np.diff(piece.bounds))
    whole = text[:n - order + 1] == text[order - 1:]
    return text[:n - order + 1][whole], value[whole]


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    encoded = column.fill_null("\0null").dictionary_encode()
    names = [None if v == "\0null" else v for v in encoded.dictionary.to_pylist()]
    return encoded.indices.to_numpy(zero_copy_only=False), names


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's texts."""
    held: dict[str | None, list] = {}
    size = 0
    for batch in batches:
        code, names = _languages(batch.column("lang"))
        for piece in pieces(batch.column("text")):
            text, value = grams(piece)
            key, n = np.unique((code[piece.first_row + text].astype(np.uint64) << np.uint64(32)) | value,
                               return_counts=True)
            of = (key >> np.uint64(32)).astype(np.int64)
            for k in np.unique(of):
                mine = of == k
                held.setdefault(names[k], []).append((key[mine] & np.uint64(0xFFFFFFFF), n[mine]))
                size += int(mine.sum())
        if size > HELD_GRAMS:
            held = {k: [_merged(v)] for k, v in held.items()}
            size = sum(len(v[0][0]) for v in held.values())
            if size > HELD_GRAMS // 2:
                yield from _handed(held)
                held, size = {}, 0
    yield from _handed({k: [_merged(v)] for k, v in held.items()})


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _handed(held: dict) -> Iterator[pa.RecordBatch]:
    for name, parts in held.items():
        for value, n in parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(value), pa.string()), pa.array(signed(value)), pa.array(n)],
                names=["lang", "gram", "n"])


def _plain(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def kneser_ney(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Written model of all documents: (lang, kind, length, gram, value).

    ``p``: log probability of an n-gram's last byte after its others; ``b``: log
    weight that a history gives to the next shorter one.
    """
    counts = (_plain(docs, lang_col, text_col).mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    tables = {ORDER: materialize(counts, "grams")}
    for k in range(ORDER - 1, 0, -1):  # shorter n-grams count the different bytes before them
        tables[k] = materialize(tables[k + 1].withColumn("gram", F.col("gram").bitwiseAND((1 << 8 * k) - 1))
                                .groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")), "grams")
    lower = None
    out = []
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("history", F.shiftright("gram", 8))
        steps = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        n = t.groupBy("lang").agg(*steps)
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

        def cut(i, y=y):
            d = F.lit(float(i)) - (i + 1) * y * F.coalesce(F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.0))
            return F.least(F.greatest(d, F.lit(0.1)), F.lit(float(i)) - 0.1)
        # one row per language
        n = F.broadcast(n.select("lang", *[cut(i).alias(f"d{i}") for i in (1, 2, 3)]))
        t = t.join(n, t["lang"].eqNullSafe(n["lang"])).drop(n["lang"])
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        after = Window.partitionBy("lang", "history")
        t = t.withColumns({"total": F.sum("c").over(after), "left": F.sum(d).over(after), "d": d})
        t = t.withColumn("back", F.col("left") / F.col("total"))
        own = (F.col("c") - F.col("d")) / F.col("total")
        if lower is None:
            t = t.withColumn("p", own + F.col("back") / 256)
        else:
            t = t.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
            less = lower.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("_p"))
            t = t.join(less, t["lang"].eqNullSafe(less["_lang"]) & (t["suffix"] == less["_gram"]))
            t = t.withColumn("p", own + F.col("back") * F.col("_p"))
        lower = materialize(t.select("lang", "gram", "history", "p", "back"), "model")
        out.append(lower.select("lang", F.lit("p").alias("kind"), F.lit(k).alias("length"), "gram", F.log("p").alias("value")))
        out.append(lower.select("lang", F.lit("b").alias("kind"), F.lit(k - 1).alias("length"),
                                F.col("history").alias("gram"), F.log("back").alias("value")).distinct())
    model = out[0]
    for part in out[1:]:
        model = model.unionByName(part)
    return model


def _lang_code(name: str | None) -> int:
    code = np.uint64(1469598103934665603)
    for b in (b"\0" if name is None else b"=" + name.encode()):
        code = mix(np.array([code ^ np.uint64(b)], np.uint64))[0]
    return int(code)


def model_arrays(rows: pa.Table) -> dict:
    """Per kind and length: sorted keys of (lang, gram) and their values."""
    lang, gram = rows.column("lang").to_pylist(), rows.column("gram").to_numpy().astype(np.uint64)
    codes = {v: _lang_code(v) for v in set(lang)}
    key = mix(np.array([codes[v] for v in lang], np.uint64) + gram * np.uint64(ODD))
    kind, length = np.array(rows.column("kind").to_pylist()), rows.column("length").to_numpy()
    value = rows.column("value").to_numpy()
    out = {}
    for k in np.unique(kind):
        for m in np.unique(length[kind == k]):
            mine = np.flatnonzero((kind == k) & (length == m))
            mine = mine[np.argsort(key[mine])]
            out[str(k), int(m)] = key[mine], value[mine]
    return out


def _look(model: dict, kind: str, length: int, key: np.ndarray) -> np.ndarray:
    """Values of keys, NaN where the model has none."""
    keys, values = model.get((kind, length), (np.zeros(0, np.uint64), np.zeros(0)))
    if not len(keys):
        return np.full(len(key), np.nan)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, values[at], np.nan)


def log_probabilities(model: dict, lang_code: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Log probability of each n-gram's last byte, backing off where the model has not seen it."""
    out = _look(model, "p", ORDER, mix(lang_code + gram * np.uint64(ODD)))
    todo, weight = np.flatnonzero(np.isnan(out)), np.zeros(len(gram))
    for k in range(ORDER, 0, -1):
        if not len(todo):
            return out
        history = (gram[todo] >> np.uint64(8)) & np.uint64((1 << 8 * (k - 1)) - 1)
        weight[todo] += np.nan_to_num(_look(model, "b", k - 1, mix(lang_code[todo] + history * np.uint64(ODD))))
        if k == 1:
            out[todo] = weight[todo] - np.log(256.0)
            break
        short = gram[todo] & np.uint64((1 << 8 * (k - 1)) - 1)
        found = _look(model, "p", k - 1, mix(lang_code[todo] + short * np.uint64(ODD)))
        out[todo] = weight[todo] + found
        todo = todo[np.isnan(found)]
    return out


def _scorer(shared):
    """Rows with the text features and, with a model, the mean log perplexity."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value if shared is not None else None
        for batch in batches:
            code, names = _languages(batch.column("_lm_lang"))
            codes = np.array([_lang_code(v) for v in names] or [0], np.uint64)
            features, mean = [[] for _ in range(5)], []
            for piece in pieces(batch.column("_lm_text")):
                for whole, part in zip(features, text_features(piece), strict=True):
                    whole.append(part)
                if model is not None:
                    text, value = grams(piece)
                    lp = log_probabilities(model, codes[code[piece.first_row + text]], value)
                    n = np.bincount(text, minlength=piece.n)
                    mean.append(np.where(n > 0, -np.bincount(text, lp, piece.n) / np.maximum(n, 1), np.nan))
            arrays = [pa.array(np.concatenate(f).astype(np.int64)) if f else pa.array([], pa.int64()) for f in features]
            if model is not None:
                arrays.append(pa.array(np.concatenate(mean) if mean else np.zeros(0), from_pandas=True))
            kept = [c for c in batch.schema.names if c not in ("_lm_lang", "_lm_text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays],
                                             names=[*kept, *OWN[:len(arrays)]])
    return step


OWN = ["_lm_n_words", "_lm_word_chars", "_lm_n_symbols", "_lm_n_dup_lines", "_lm_n_repeat_words", "_lm_log_ppl"]


def _doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, lang, gram, n) per document, for models too large to hand out."""
    for batch in batches:
        digests, langs = batch.column("digest").to_numpy(), batch.column("lang")
        for piece in pieces(batch.column("text")):
            text, value = grams(piece)
            for i in np.unique(text):
                gram, n = np.unique(value[text == i], return_counts=True)
                row = piece.first_row + int(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), digests[row])), pa.array([langs[row].as_py()] * len(gram), pa.string()),
                     pa.array(signed(gram)), pa.array(n)], names=["digest", "lang", "gram", "n"])


def joined_perplexity(docs: DataFrame, model: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(digest, log_ppl) per different (lang, text), by joins of n-grams with the model."""
    plain = _plain(docs, lang_col, text_col).withColumn("digest", F.xxhash64("lang", "text")).dropDuplicates(["digest"])
    rows = plain.mapInArrow(_doc_grams, "digest long, lang string, gram long, n long")
    rows = rows.withColumns({"weight": F.lit(0.0), "lp": F.lit(None).cast("double")})

    def look(rows: DataFrame, kind: str, length: int, gram) -> DataFrame:
        part = model.filter((F.col("kind") == kind) & (F.col("length") == length)).select(
            F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("value").alias("_value"))
        keyed = rows.withColumn("_key", gram)
        return keyed.join(part, keyed["lang"].eqNullSafe(part["_lang"]) & (keyed["_key"] == part["_gram"]), "left")

    for k in range(ORDER, 0, -1):
        low = (1 << 8 * k) - 1
        rows = look(rows, "p", k, F.col("gram").bitwiseAND(low))
        rows = rows.withColumn("lp", F.coalesce("lp", F.col("weight") + F.col("_value"))).drop("_lang", "_gram", "_value", "_key")
        rows = look(rows, "b", k - 1, F.shiftright(F.col("gram").bitwiseAND(low), 8))
        rows = rows.withColumn("weight", F.col("weight") + F.coalesce("_value", F.lit(0.0))).drop("_lang", "_gram", "_value", "_key")
    lp = F.coalesce("lp", F.col("weight") - F.log(F.lit(256.0)))
    return rows.groupBy("digest").agg((-F.sum(lp * F.col("n")) / F.sum("n")).alias("log_ppl"))


def scored(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", keep: list[str] | None = None,
           max_model_rows: int = MAX_MODEL_ROWS) -> DataFrame:
    """Columns ``keep`` (all by default) of ``docs`` with the features and log perplexity in ``_lm_`` columns; written."""
    spark: SparkSession = docs.sparkSession
    keep = docs.columns if keep is None else keep
    model = kneser_ney(docs, lang_col, text_col)
    small = model.limit(max_model_rows + 1).count() <= max_model_rows
    shared = spark.sparkContext.broadcast(model_arrays(model.toArrow())) if small else None
    wide = docs.select(*[F.col(c) for c in keep], F.col(lang_col).cast("string").alias("_lm_lang"),
                       F.xxhash64(F.col(lang_col).cast("string"), F.col(text_col)).alias("_lm_digest"),
                       F.col(lang_col).cast("string").alias("_lm_group"), F.col(text_col).alias("_lm_text"))
    own = OWN if small else OWN[:5]
    schema = wide.drop("_lm_lang", "_lm_text").schema
    for name in own:
        schema = schema.add(name, "double" if name == "_lm_log_ppl" else "long")
    if small:
        wide = wide.drop("_lm_digest")
        schema = type(schema)([f for f in schema.fields if f.name != "_lm_digest"])
    out = wide.mapInArrow(_scorer(shared), schema)
    if not small:
        lp = joined_perplexity(docs, model, lang_col, text_col).select(
            F.col("digest").alias("_lm_digest"), F.col("log_ppl").alias("_lm_log_ppl"))
        out = out.join(lp, "_lm_digest", "left").drop("_lm_digest")
    return materialize(out, "scored")


def with_verdict(rows: DataFrame, band: float = BAND) -> DataFrame:
    """Scored rows with ``_lm_base_failed`` and ``_lm_kept``, by bands over all of them."""
    lp = rows.filter(F.col("_lm_log_ppl").isNotNull()).select("_lm_group", F.round("_lm_log_ppl", 3).alias("v"))
    # exact quartiles of the rounded values: a language has some thousand different ones
    values = lp.groupBy("_lm_group", "v").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("_lm_group").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("_lm_group"))})
    q1, q2, q3 = (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))) for q in (0.25, 0.5, 0.75))
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(0.001)))
    side = lambda a, b: F.greatest(log(a) - log(b), F.lit(LEAST_SPREAD))
    bands = (values.groupBy("_lm_group").agg(q1.alias("q1"), q2.alias("q2"), q3.alias("q3"))
             .select(F.col("_lm_group").alias("_lm_of"), log("q2").alias("_lm_middle"), side("q2", "q1").alias("_lm_below"),
                     side("q3", "q2").alias("_lm_above")))
    judged = rows.join(F.broadcast(bands), F.col("_lm_group").eqNullSafe(F.col("_lm_of")), "left")  # a row per language
    failed = (F.col("_lm_n_words") < MIN_WORDS) | (100 * F.col("_lm_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_lm_n_words"))
    wide = band * F.sqrt(F.greatest(F.lit(1.0), F.lit(FULL_WORDS) / F.greatest("_lm_n_words", F.lit(1))))
    off = F.log(F.greatest(F.round("_lm_log_ppl", 3), F.lit(0.001))) - F.col("_lm_middle")
    inside = F.coalesce(off.between(-wide * F.col("_lm_below"), wide * F.col("_lm_above")), F.lit(True))
    return judged.withColumns({"_lm_base_failed": failed, "_lm_kept": ~failed & inside}).drop(
        "_lm_of", "_lm_middle", "_lm_below", "_lm_above", "_lm_group")
