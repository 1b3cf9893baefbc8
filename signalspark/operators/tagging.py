"""Entity tagging with a dictionary too large for a chain of conditions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.functions.text import upper_each
from signalspark.operators.joins import lookup_join
from signalspark.storage import materialize

#: Characters of keywords in one automaton, some hundred bytes of memory each at most.
SLICE_CHARS = 4_000_000


def tag_by_dictionary(news: DataFrame, dictionary: DataFrame, key: str,
                      headline: str = "Headlines", description: str = "Description",
                      **join_limits: float) -> DataFrame:
    """Add ``Ticker``: the entity of the best ranked keyword found as a whole word.

    ``dictionary`` is a written table ``(word, rank, Ticker)`` with upper-case
    words of letters and digits, unique per word; the smallest rank wins. ``key``
    identifies a news row. Only the words of a text that are in the dictionary
    leave the map tasks; texts are not shuffled with them.
    """
    words = F.split(upper_each(F.concat_ws(" ", headline, description)), r"[^\p{L}\p{N}]+")
    each = news.select(key, F.explode(F.array_distinct(words)).alias("word"))
    hits = lookup_join(each, dictionary, ["word"], "inner", [key], **join_limits)
    tags = hits.groupBy(key).agg(F.min_by("Ticker", "rank").alias("Ticker"))
    return news.drop("Ticker").join(tags, key)


def tag_by_substring(news: DataFrame, dictionary: DataFrame, key: str,
                     headline: str = "Headlines", description: str = "Description",
                     slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Add ``Ticker``: the entity of the best ranked keyword found anywhere in the text, also inside words.

    ``dictionary`` is a written table ``(word, rank, Ticker)`` of keywords of any characters in
    upper case (``upper_each``); the smallest rank wins, then the first word. Equals ``tag_entity`` with
    substrings, at a cost that does not grow with the number of keywords: one automaton
    reads each text once. Up to ``slice_chars`` the texts are not shuffled. A larger dictionary
    is cut into ranges of words, each with an automaton of its own; only hits are then
    shuffled. ``key`` identifies a news row. Rows without a hit are left out.
    """
    known = dictionary.filter("word is not null").select("word", "rank", "Ticker")
    slices = _word_ranges(known, slice_chars)
    text = upper_each(F.concat_ws(" ", headline, description)).alias("_text")
    if len(slices) == 1:
        hit = _best_hits(news.select("*", text), slices[0], [c for c in news.columns if c != "Ticker"])
        return hit.drop("_rank", "_word")
    parts = [_best_hits(news.select(key, text), s, [key]) for s in slices]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    best = hits.groupBy(key).agg(F.min_by("Ticker", F.struct("_rank", "_word")).alias("Ticker"))
    return news.drop("Ticker").join(best, key)


def _word_ranges(dictionary: DataFrame, slice_chars: int) -> list[DataFrame]:
    """The dictionary by ranges of words of about ``slice_chars`` characters each."""
    total = dictionary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    n = -(-total // slice_chars)
    if n <= 1:
        return [dictionary]
    dealt = materialize(dictionary.repartitionByRange(n, "word").withColumn("_slice", F.spark_partition_id()), "keywords")
    return [dealt.filter(F.col("_slice") == k).drop("_slice") for k in range(n)]


def _best_hits(texts: DataFrame, keywords: DataFrame, kept: list[str]) -> DataFrame:
    """Rows of ``texts`` with a hit: ``kept``, Ticker, _rank and _word of the best one."""
    first = Window.partitionBy("word").orderBy("rank", "Ticker")
    words = keywords.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    # one slice, of a checked number of characters
    rows = sorted((r.rank, r.word, r.Ticker) for r in words.collect())
    shared = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        entries = shared.value
        automaton = ahocorasick.Automaton()
        # entries are in order, so the least place is the best hit; the empty keyword is in every text
        anywhere = min((k for k, (_, word, _) in enumerate(entries) if not word), default=len(entries))
        for k, (_, word, _) in enumerate(entries):
            if word:
                automaton.add_word(word, k)
        automaton.make_automaton()
        search = automaton.iter if len(automaton) else lambda text: ()
        for batch in batches:
            best = [min((k for _, k in search(text)), default=anywhere) for text in batch.column("_text").to_pylist()]
            best = [min(k, anywhere) for k in best]
            found = [i for i, k in enumerate(best) if k < len(entries)]
            if found:
                some = batch.select(kept).take(pa.array(found))
                chosen = [entries[best[i]] for i in found]
                added = [pa.array([e[2] for e in chosen], pa.string()), pa.array([e[0] for e in chosen], pa.int64()),
                         pa.array([e[1] for e in chosen], pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=[*kept, "Ticker", "_rank", "_word"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in kept)
    return texts.select(*kept, "_text").mapInArrow(run, f"{kinds}, Ticker string, _rank bigint, _word string")
