import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.functions.text import DEFAULT_KEYWORDS, clean_text, combined_text, softmax, tag_entity, upper_each, upper_word
from signalspark.operators import scoring
from signalspark.operators.tagging import tag_by_dictionary, tag_by_substring
from signalspark.storage import ARROW_ROWS_CONF, TEXT_ROWS
from signalspark.streaming.scores import follow_news

GOOD, BAD = ("gain", "win"), ("loss",)


def test_tags_of_known_headlines(spark):
    rows = [("Apple announces new iPhone", "AAPL"), ("AAPL stock rises", "AAPL"),
            ("Microsoft Azure growth", "MSFT"), ("MSFT earnings beat", "MSFT"),
            ("Market news today", None), ("Apple sues Microsoft", "AAPL"), ("Machine learning", "AAPL")]
    df = spark.createDataFrame(rows, "h string, want string").withColumn("d", F.lit(None).cast("string"))
    got = df.select("h", "want", tag_entity("h", "d").alias("t"),
                    tag_entity("h", match="word").alias("w")).collect()
    assert all(r.t == r.want for r in got)
    assert [r.w for r in got][-1] is None  # "MAC" only inside a longer word
    with pytest.raises(ValueError):
        tag_entity("h", match="fuzzy")


def test_dictionary_join_tags_like_the_conditions(spark):
    rows = [(0, "Apple and Azure", None), (1, "azure, only", "x"), (2, "Machine", "pineapple"), (3, "xbox", "MAC!")]
    df = spark.createDataFrame(rows, "id int, Headlines string, Description string")
    pairs = [(w, t) for t, words in DEFAULT_KEYWORDS.items() for w in words]
    dictionary = spark.createDataFrame([(w, i, t) for i, (w, t) in enumerate(pairs)],
                                       "word string, rank int, Ticker string")
    want = {r.id: r.t for r in df.select("id", tag_entity("Headlines", "Description", match="word")
                                         .alias("t")).collect() if r.t}
    for limits in ({}, {"max_broadcast_rows": 0, "sample_fraction": 1.0}):
        got = tag_by_dictionary(df, dictionary, "id", **limits).collect()
        assert {r.id: r.Ticker for r in got} == want == {0: "AAPL", 1: "MSFT", 3: "AAPL"}


def test_cleaning(spark):
    rows = [(None, None, "", ""), ("  a \n\t b ", "c", "a b", "a b c"), ("x  y", " ", "x y", "x y")]
    df = spark.createDataFrame(rows, "h string, d string, one string, two string")
    for r in df.select("one", "two", clean_text("h").alias("a"), combined_text("h", "d").alias("b")).collect():
        assert (r.a, r.b) == (r.one, r.two)


def news(spark, rows):
    return spark.createDataFrame(rows, "Headlines string, Time timestamp_ntz, Description string")


T0 = datetime(2024, 1, 1, 10)


def test_batch_scores_equal_native_lexicon_and_count_copies_once(spark):
    rows = [("gain gain loss", T0, None), ("", T0, ""), ("Win!", T0, "nothing")] + [("copy", T0, "x")] * 50
    df = news(spark, rows)
    batch = scoring.score_texts(df, scoring.lexicon_predict_fn(GOOD, BAD))
    salted = scoring.score_texts(df, scoring.lexicon_predict_fn(GOOD, BAD), max_broadcast_rows=0)
    native = scoring.score_lexicon(scoring.with_text(df), "combined_text", GOOD, BAD).drop(
        "combined_text", "text_key")
    key = lambda d: sorted([tuple(map(str, r[:3])) + tuple(np.round(r[3:], 9)) for r in d.collect()])
    assert key(batch) == key(salted) == key(native)
    assert scoring.distinct_texts(scoring.with_text(df)).count() == 4
    one = [r for r in batch.collect() if r.Headlines == "gain gain loss"][0]
    assert one.sentiment_score == pytest.approx(3 / 6 - 2 / 6)


def test_labels_are_bound_by_name(spark):
    def make():
        return lambda texts: np.tile([0.7, 0.2, 0.1], (len(texts), 1))

    texts = scoring.distinct_texts(scoring.with_text(news(spark, [("a", T0, "b")])))
    row = scoring.score_distinct(texts, make, ("positive", "negative", "neutral")).first()
    assert (row.positive, row.negative, row.neutral) == (0.7, 0.2, 0.1)
    assert row.sentiment_score == pytest.approx(0.5)
    with pytest.raises(ValueError):
        scoring.score_distinct(texts, make, ("good", "bad", "ugly"))


def test_score_store_only_scores_what_is_new(spark, tmp_path):
    store, predict = str(tmp_path / "store"), scoring.lexicon_predict_fn(GOOD, BAD)
    first = news(spark, [("gain", T0, None), ("loss", T0, None)])
    assert scoring.score_with_store(first, predict, store, "v1").count() == 2
    more = news(spark, [("gain", T0, None), ("new", T0, None)])
    todo = scoring.pending_texts(scoring.with_text(more), scoring.read_scores(spark, store), "v1")
    assert [r.combined_text for r in todo.collect()] == ["new"]
    assert scoring.score_with_store(more, predict, store, "v1").count() == 2
    assert scoring.read_scores(spark, store).count() == 3
    # another version starts anew, a refresh replaces its own texts in its own version only
    scoring.score_with_store(more, predict, store, "v2")
    flat = lambda: lambda texts: np.full((len(texts), 3), 1 / 3)
    again = scoring.score_with_store(more, flat, store, "v1", force_refresh=True)
    assert {r.sentiment_score for r in again.collect()} == {0.0}
    counts = {r.model_version: r["count"] for r in
              scoring.read_scores(spark, store).groupBy("model_version").count().collect()}
    assert counts == {"v1": 3, "v2": 2}
    kept = scoring.read_scores(spark, store).filter("model_version = 'v1' and sentiment_score <> 0")
    assert kept.count() == 1  # "loss" was not among the refreshed texts


def test_stream_keeps_the_store_current(spark, tmp_path):
    folder, store, check = (str(tmp_path / n) for n in ("news", "store", "check"))
    predict = scoring.lexicon_predict_fn(GOOD, BAD)
    for rows, want in (([("gain", T0, None), ("gain", T0, None)], 1), ([("gain", T0, "x")], 2)):
        news(spark, rows).write.mode("append").parquet(folder)
        query = follow_news(spark, folder, store, check, predict, "v1")
        query.awaitTermination(120)
        assert scoring.read_scores(spark, store).count() == want


@pytest.mark.parametrize("limit", [10**9, 300_000])
def test_large_dictionary_of_substrings_equals_contains(spark, limit):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ABCDEFGHÉ日 .*") for _ in range(n))
    words = sorted({draw(rng.randint(3, 9)) for _ in range(100_000)}) + ["IPHONE", "MAC"]
    rng.shuffle(words)
    entries = [(w, k // 2, f"T{k % 5}") for k, w in enumerate(words)]  # ranks tie
    texts = [draw(rng.randint(0, 40)).lower() for _ in range(300)] + ["", None, "a machine", "x" * 50_000 + "iphone"]
    news = spark.createDataFrame([(k, t, None, "old", 5) for k, t in enumerate(texts)],
                                 "id int, Headlines string, Description string, Ticker string, word int").repartition(3)
    dictionary = spark.createDataFrame([*entries, *entries[:5], (None, 0, "none")], "word string, rank int, Ticker string")
    got = {r.id: r.Ticker for r in tag_by_substring(news, dictionary, "id", slice_chars=limit).collect()}
    want = {}
    for k, text in enumerate(texts):
        hits = [(rank, w, t) for w, rank, t in entries if w in (text or "").upper()]
        if hits:
            want[k] = min(hits)[2]
    assert got == want and len(want) > 100
    same = tag_by_substring(news, dictionary.filter("word = 'MAC'").unionByName(spark.createDataFrame(
        [("", 10**6, "any")], "word string, rank int, Ticker string")), "id", slice_chars=limit)
    assert {r.id: r.Ticker for r in same.collect()}[0] == "any" and same.count() == len(texts)
    assert tag_by_substring(news, dictionary.limit(0), "id").count() == 0


def test_softmax_is_stable(spark):
    rows = [([1.0, 2.0, 3.0],), ([1000.0, 1000.0],), ([-1e308, 1e308],), ([],), (None,), ([1.0, None],)]
    got = [r.p for r in spark.createDataFrame(rows, "l array<double>").select(softmax("l").alias("p")).collect()]
    e = [math.exp(v) for v in (1, 2, 3)]
    assert got[0] == pytest.approx([v / sum(e) for v in e])
    assert got[1:] == [[0.5, 0.5], [0.0, 1.0], [], None, None]


def test_batches_by_padded_size(spark):
    rng = random.Random(5)
    sizes = sorted([rng.randint(0, 40) for _ in range(200)] + [10_000])
    cuts = scoring.budget_batches(np.array(sizes), 400)
    assert [k for c in cuts for k in range(c.start, c.stop)] == list(range(201))
    assert all(max(sizes[c]) * len(sizes[c]) <= 400 or len(sizes[c]) == 1 for c in cuts[:-1]) and sizes[cuts[-1]] == [10_000]
    assert scoring.budget_batches(np.zeros(0), 5) == []
    texts = [" ".join(rng.choice(["gain", "loss", "and", "win", "x"]) for _ in range(rng.choice([1, 3, 200]))) for _ in range(300)]
    rows = [(k, t, None, datetime(2024, 1, 1)) for k, t in enumerate([*texts, "gain " * 40_000, "", texts[0]])]
    news = spark.createDataFrame(rows, "id int, Headlines string, Description string, Time timestamp").repartition(3)
    key = lambda df: sorted((r.id, round(r.negative, 9), round(r.sentiment_score, 9)) for r in df.collect())
    predict = scoring.lexicon_predict_fn(GOOD, BAD)
    assert key(scoring.score_texts(news, predict)) == key(scoring.score_texts(news, predict, budget=5_000))
    shares = scoring.padding_share(scoring.distinct_texts(scoring.with_text(news)), budget=5_000).first()
    assert shares.by_budget < 0.2 < 0.5 < shares.by_number
    with pytest.raises(ValueError):
        scoring.score_budgeted(news, predict, labels=("a", "b"))


def test_upper_case_of_every_character_on_its_own(spark):
    import duckdb

    texts = [*[c for c in map(chr, range(1, 0x10000)) if c.upper() != c], "Große Straße", "ein ﬁnger, ŉ ᾳᾈ ßß", "ﬁ", "aﬀ\nb", "", None]
    got = [r.u for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(upper_each("t").alias("u")).collect()]
    want = duckdb.execute("SELECT upper(t) FROM (SELECT unnest($1::VARCHAR[]) AS t)", [texts]).fetchall()
    assert [(t, g) for t, g, (w,) in zip(texts, got, want) if g != w] == []
    assert [upper_word(t) for t in texts[:-1]] == got[:-1]


def test_tags_of_a_sharp_s(spark):
    rows = [(0, "Waßer", "die Strasse"), (1, "was", "Straße"), (2, "ﬁn", "")]
    df = spark.createDataFrame(rows, "id int, Headlines string, Description string")
    words = spark.createDataFrame([("STRASSE", 1, "S"), ("STRAẞE", 2, "Z"), ("FIN", 3, "F")], "word string, rank int, Ticker string")
    assert {r.id: r.Ticker for r in tag_by_substring(df, words, "id").collect()} == {0: "S", 1: "Z"}
    assert {r.id: r.Ticker for r in tag_by_dictionary(df, words, "id").collect()} == {0: "S", 1: "Z"}
    tags = df.select(tag_entity("Headlines", keywords={"E4": ("WAS",), "Z": ("waß",)}).alias("t")).collect()
    assert [r.t for r in tags] == ["Z", "E4", None]


@pytest.mark.parametrize("sizes", [{"budget": 1 << 40}, {"batch_size": 1 << 20}])
def test_workers_hold_a_bounded_number_of_texts(spark, tmp_path, sizes):
    rows = [(k, f"gain {k}", None, datetime(2024, 1, 1)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, Headlines string, Description string, Time timestamp").coalesce(1)
    lexicon = scoring.lexicon_predict_fn(GOOD, BAD)

    def make():
        predict = lexicon()

        def run(texts):
            assert len(texts) <= TEXT_ROWS
            return predict(texts)

        return run

    before = spark.conf.get(ARROW_ROWS_CONF)
    assert scoring.score_texts(df, make, **sizes).filter("positive = 0.5").count() == 3000  # (1 + 1) / (1 + 3)
    scoring.append_scores(scoring.distinct_texts(scoring.with_text(df)), lexicon, str(tmp_path / "store"), "v")
    assert spark.conf.get(ARROW_ROWS_CONF) == before and int(before) > TEXT_ROWS
