"""Operators over documents against brute force on one table with all edge cases."""

import base64
import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from signalspark.llm import (bpe, chosen_path, compact_windows, line_dedup, mixing, perplexity, pii, sharding,
                             window_dedup)
from signalspark.llm.components import connected_components
from signalspark.llm.perplexity import text_features
from signalspark.llm.words import pieces, range_hashes, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def unite(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def first_rows(rows):
    """Different (id, text), null ids first, null texts empty; ids are unique but for nulls."""
    return sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows})


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 1), (20, 21), (21, 20), (4, 4), *[(100, k) for k in range(101, 400)], *[(k, k + 1) for k in range(500, 540)]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in (1, 3, 5, 9)}, 20: 20, 21: 20, **{k: 100 for k in range(100, 400)}, **{k: 500 for k in range(500, 541)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(docs, rows, no_docs):
    got = {(r.id, r.digest): r.removed for r in line_dedup.removed_lines(docs).collect()}
    digests = {(r.doc_id, r.text or ""): r.d for r in docs.select("doc_id", "text", F.xxhash64("text").alias("d")).collect()}
    shingle = regex.compile(line_dedup.SHINGLES)
    every = sorted({(-1 if r[0] is None else r[0], digests[r[0], r[1] or ""], k, line) for r in rows
                    for k, line in enumerate((r[1] or "").split("\n")) if WORD.search(line)})
    lines = sorted({x[3] for x in every})
    sets = [set(shingle.findall(x)) for x in lines]
    parent = {k: k for k in range(len(lines))}
    for a in range(len(lines)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                unite(parent, a, b)
    place, seen, want = {x: k for k, x in enumerate(lines)}, set(), defaultdict(list)
    for i, digest, k, line in every:
        root = find(parent, place[line])
        if root in seen:
            want[None if i < 0 else i, digest].append(k)
        seen.add(root)
    assert got == want and len(want) > 10
    changed = line_dedup.with_removed(docs).withColumn("text", line_dedup.kept_text()).select("doc_id", "text", "_removed", "h").collect()
    assert len(changed) == len(rows)
    assert all(r._removed is None or r.text is not None for r in changed)
    assert line_dedup.removed_lines(no_docs).count() == 0


def plain_shingles(line):
    return {line[k:k + line_dedup.LENGTH] for k in range(max(len(line) - line_dedup.LENGTH, 0) + 1)}


def removed_of(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: r.removed for r in line_dedup.removed_lines(table).collect()}


def test_lines_without_blanks(spark):
    rng = np.random.default_rng(4)
    encoded = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 300))
    record = ",".join(str(k) for k in rng.integers(100, 10 ** 6, 60))
    url = "://data.example.org/" + "/".join("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(20)) + "?id=1"
    texts = [encoded, encoded[:40] + "x" + encoded[40:], record, "1" + record, "http" + url, "https" + url, encoded[::-1]]
    assert removed_of(spark, texts) == {1: [0], 3: [0], 5: [0]}
    for line in [*texts, "", "abc", "日本語の行\r", "\U0001f600 and more of it", "x" * line_dedup.LENGTH]:
        got = spark.createDataFrame([(line,)], "line string").select(line_dedup.shingles("line")).first()[0]
        assert set(got) == (plain_shingles(line) if line else set())


@pytest.mark.parametrize("size", [9, 14, 24, 60])
def test_recall_by_length(spark, size):
    """Pairs at or just above the threshold: a line and the same with characters added at its end."""
    rng = np.random.default_rng(size)
    shingles = size - line_dedup.LENGTH + 1
    texts = []
    for _ in range(400):
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), size))
        texts.append(f"{line}\n{line}{''.join(rng.choice(list('ABCDEFGH'), shingles // 4))}")
    removed = removed_of(spark, texts)
    assert sum(removed.get(k) == [1] for k in range(400)) >= 0.98 * 400


def test_short_lines_with_one_edit(spark):
    typo = "The committee will publish its next report at the end of this quarter"
    year = "Copyright (c) 2019 by Example Authors and others, all rights held."
    least = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVW"
    assert len(least) == 49
    texts = [typo, typo.replace("publish", "publiss"), year, year.replace("2019", "2021"), least, least[:24] + "." + least[25:]]
    assert removed_of(spark, texts) == {1: [0], 3: [0], 5: [0]}


def test_lines_write_no_texts_or_sets(spark, monkeypatch):
    """What is written grows with the number of lines, not with their characters."""
    rng, written = np.random.default_rng(8), []
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 4000)) for _ in range(20)]
    texts += [t[:2000] + "#" + t[2000:] for t in texts]
    plain = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: written.append(plain(df, name)) or written[-1])
    assert removed_of(spark, texts) == {k: [0] for k in range(20, 40)}
    assert all(t not in ("string", "binary") and (t != "array<bigint>") for df in written for _, t in df.dtypes)


def test_line_shingles_by_place(spark):
    """The shingles cut from the coded line are those of the definition."""
    for line in ["a", "abcd", "abcde", "abcdef", "日本語の行です\r", "\U0001f600 and more of it", "aaaaaaaaaa", "é" * 7]:
        row = spark.createDataFrame([(line,)], "line string").select("line", line_dedup.coded("line").alias("code"))
        cut = F.transform(line_dedup.starts("code"), lambda k: F.substr(F.col("code"), k, F.lit(4 * line_dedup.LENGTH)))
        assert {bytes(c).decode("utf-32-be") for c in row.select(cut).first()[0]} == plain_shingles(line)


def test_signatures_in_blocks(spark):
    """Lines of every length around a block have the least hash of all their shingles, none beyond their end."""
    lines = ["日本語の行abcdefghijklmnopqrstuvwxyz0123456789"[:n] for n in range(1, 30)] * 2
    table = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    keyed = {r.h: r for r in line_dedup.band_keys(table).collect()}
    for line, h in {(r.line, r.h) for r in table.collect()}:
        pieces = spark.createDataFrame([(p.encode("utf-32-be"),) for p in plain_shingles(line)], "p binary")
        high = [r[0] >> 32 for r in pieces.select(F.xxhash64("p")).collect()]
        codes = [(i << 27) - (1 << 32 if i >= 16 else 0) for i in range(line_dedup.BANDS * line_dedup.ROWS)]
        least = [min(x ^ c for x in high) % 256 for c in codes]
        assert [keyed[h][f"s{k}"] >> 8 * i & 255 for k in range(line_dedup.ROWS) for i in range(line_dedup.BANDS)] == least
        assert keyed[h].copies == 2


def test_line_filter_is_small(spark):
    """The filter keeps every wanted line, and what is broadcast is a row per 64 slots at most."""
    rows = spark.range(300_000).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.filter("id % 3 = 0").select("h")
    kept = line_dedup.among(rows, wanted)
    assert kept.columns == ["h", "id"]
    assert kept.filter("id % 3 = 0").count() == 100_000 and kept.count() < 110_000
    every = spark.range(1 << 17).select(F.col("id").alias("h"))
    kept = line_dedup.among(every, every)
    assert kept.count() == 1 << 17
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "_word" in plan


def test_written_tables_free_their_shuffles(spark):
    """Shuffle files of a written table are gone when it is written, and the setting is as before."""
    import glob

    from signalspark import storage

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    count = lambda: len(glob.glob(f"{folder}/*/shuffle_*.data"))
    before, setting = count(), spark.conf.get(storage.CLEANUP_CONF, None)
    table = storage.materialize(spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).count().repartition(3), "freed")
    for _ in range(50):
        if count() <= before:
            break
        time.sleep(0.1)
    assert count() <= before and table.count() == 7000
    assert spark.conf.get(storage.CLEANUP_CONF, None) == setting


def test_personal_data(docs, rows, no_docs):
    field = pii.train(docs)
    got = {(r.doc_id, r.base_sha256): r for r in pii.personal_data(docs, field=field).collect()}
    patterns = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    digits = lambda s: re.sub(r"\D", "", s)
    holds = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
             lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    total = 0
    for r in rows:
        spans = sorted((m.start(), k, m.end()) for k in range(4) for m in patterns[k].finditer(r[1] or "") if holds[k](m.group()))
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        out = got[r[0], hashlib.sha256(text.encode()).hexdigest()]
        assert [out.n_email, out.n_ip, out.n_card, out.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert set(filter(None, text.split(","))) <= set(out.spans.split(","))
        total += len(spans)
    assert total >= 5
    assert pii.personal_data(no_docs).count() == 0


def test_field_learns_segments_and_boundaries():
    good = [f"the key is AKIA{k:016d} here".replace("0", "Q") for k in range(1000, 1060)]
    calls = [f"call +1 ({200 + k}) 555-{1000 + k} now" for k in range(60)]
    field = pii.SemiMarkov()
    field.fit([x for t in good[:40] + calls[:40] for x in pii.labelled(t)])
    for t in good[40:]:
        base, spans = pii.all_spans(t, field)
        assert not base and [t[s:e] for s, _, e in spans] == [t.split()[3]]
    words = next(pii.chunks(calls[-1]))
    assert any(j - i == 3 and pii.LABELS[label] == "phone" for i, j, label in field.best(words))
    lattice = field.lattice(words)
    forward, backward = field.sums(lattice, len(words))
    assert forward[-1] == pytest.approx(backward[0])


def test_text_rules_and_model(spark, docs, rows, no_docs):
    out = perplexity.with_verdict(perplexity.scored(docs)).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.text): r for r in out}
    for r in rows:
        text, g = r[1] or "", by[r[0], r[1]]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        shingles = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        n = Counter(shingles)
        covered = {j for k, s in enumerate(shingles) if n[s] > 1 for j in range(k, k + 5)}
        assert (g._lm_n_words, g._lm_word_chars, g._lm_n_symbols, g._lm_n_dup_lines, g._lm_n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert g._lm_base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    joined = perplexity.with_verdict(perplexity.scored(docs, max_model_rows=10)).collect()
    same = {(r.doc_id, r.text): r for r in joined}
    assert all(same[k]._lm_kept == r._lm_kept and (r._lm_log_ppl is None) == (same[k]._lm_log_ppl is None)
               and (r._lm_log_ppl is None or abs(r._lm_log_ppl - same[k]._lm_log_ppl) < 1e-9) for k, r in by.items())
    assert perplexity.scored(no_docs).count() == 0


def test_bands_reject_on_both_sides(spark):
    rng = np.random.default_rng(6)
    texts, planted = [], {}
    for lang, letters in (("en", "etaoinshr"), ("fr", "esaitnrul")):
        # a language of its own words, some of them frequent
        words = ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(400)]
        for _ in range(300):
            texts.append((" ".join(words[int(k)] for k in np.minimum(rng.zipf(1.3, rng.integers(20, 500)), 400) - 1), lang))
        for k in range(3):
            planted[len(texts)] = "above"
            texts.append((" ".join("".join(rng.choice(list("qzxjkvwy0123456789"), 7)) for _ in range(200)), lang))
            planted[len(texts)] = "below"  # two words in turn, in runs that no window of five repeats often enough to count
            texts.append((" ".join(words[0] + words[1] * (j % 90 + 1) for j in range(80 + k)), lang))
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in perplexity.with_verdict(perplexity.scored(df)).collect()}
    for k, side in planted.items():
        lp = sorted(r._lm_log_ppl for r in out.values() if r.lang == out[k].lang)
        assert not out[k]._lm_base_failed and not out[k]._lm_kept
        assert (out[k]._lm_log_ppl > lp[len(lp) // 2]) == (side == "above")
    clean = [r for k, r in out.items() if k not in planted and not r._lm_base_failed]
    assert len(clean) > 300 and np.mean([r._lm_kept for r in clean]) > 0.99


def test_model_is_a_distribution(spark):
    df = spark.createDataFrame([("abcabdabcabcxyz zyx abcd " * 3, "en"), ("les amis de la mer", "fr")], "text string, lang string")
    model = perplexity.model_arrays(perplexity.kneser_ney(df).toArrow())
    code = perplexity._lang_code("en")
    for history in (b"abc", b"zyx", b"qqq", b"abq"):
        grams = np.array([int.from_bytes(history + bytes([b]), "big") for b in range(256)], np.uint64)
        p = np.exp(perplexity.log_probabilities(model, np.full(256, code, np.uint64), grams))
        assert p.sum() == pytest.approx(1.0, abs=1e-6)


def test_repeated_windows(docs, rows, no_docs):
    got = {(r.doc_id, r.n_bytes, r.kept_sha256): r for r in window_dedup.repeated_windows(docs).collect()}
    seen, order = set(), first_rows(rows)
    for i, text in order:
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        r = got[None if i < 0 else i, len(raw), hashlib.sha256(kept).hexdigest()]
        assert r.n_removed == sum(gone) and r.n_spans == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    assert any(r.n_removed for r in got.values())
    assert window_dedup.repeated_windows(no_docs).count() == 0


def test_hot_windows_give_the_same(docs, monkeypatch):
    plain = {tuple(r) for r in window_dedup.repeated_windows(docs).drop("removed").collect()}
    monkeypatch.setattr(window_dedup, "HOT_DOCS", 2)
    monkeypatch.setattr(window_dedup, "BATCH_RUNS", 5)
    assert {tuple(r) for r in window_dedup.repeated_windows(docs).drop("removed").collect()} == plain
    monkeypatch.setattr(window_dedup, "HOT_DOCS", 10 ** 9)
    assert {tuple(r) for r in window_dedup.repeated_windows(docs).drop("removed").collect()} == plain


def test_jaccard_join(docs, rows, no_docs):
    got = chosen_path.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    texts = sorted({r[1] or "" for r in rows})
    sets = {}
    for t in texts:
        w = WORD.findall(t)
        sets[t] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    weight = Counter(r[1] or "" for r in rows)
    parent, links = {t: t for t in texts}, Counter()
    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if common and a < b and 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                unite(parent, a, b)
                links[a] += weight[b]
                links[b] += weight[a]
    ids = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            ids[find(parent, r[1] or "")].append(r[0])
    text_of = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is None:
            continue
        t = text_of[r.doc_id]
        assert r.n_links == (links[t] + weight[t] - 1 if sets[t] else 0)
        assert r.class_id == (min(ids[find(parent, t)]) if sets[t] else r.doc_id)
    assert max(r.n_links for r in got) >= 10
    assert chosen_path.jaccard_join(no_docs).count() == 0


def test_meetings_of_blocks_give_the_same(docs, monkeypatch):
    plain = sorted(map(str, chosen_path.jaccard_join(docs).collect()))
    monkeypatch.setattr(chosen_path, "SMALL", 2)
    monkeypatch.setattr(chosen_path.blocked, "__defaults__", (4,))
    assert sorted(map(str, chosen_path.jaccard_join(docs).collect())) == plain
    assert chosen_path.meeting_chance() > 0.3 and chosen_path.runs_for(0.99) <= 15


def test_shards(docs, rows, no_docs):
    got = sharding.feistel_shards(docs, shards=8).collect()
    n = len(rows)
    assert sorted(r.number for r in got) == list(range(n))
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in sizes)
    import zlib
    want = Counter((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.size, r.text_crc32) for r in got) == want
    again = sharding.feistel_shards(docs.repartition(7), shards=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.feistel_shards(no_docs).count() == 0


def test_shards_of_one_repeated_row(spark):
    df = spark.range(9000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.feistel_shards(df, shards=4)
    assert [r[1] for r in got.groupBy("shard").count().orderBy("shard").collect()] == [2250] * 4
    assert got.select("number").distinct().count() == 9000


def test_bpe(spark, docs, rows, no_docs):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path, pattern = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    extra = [(900 + k, t, "en", "a", 0, *rows[0][5:]) for k, t in enumerate(
        ["a b  c  d\r\n\r\n e", "<|endoftext|> don't we'll 12345 ½x", "\U0001f600 \x1c\x85 z", "='" * 40])]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = Counter(tuple(r) for r in bpe.digests(bpe.encoded(table, path, pattern)).collect())
    want = Counter()
    for r in rows + extra:
        ids = coder.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encoded(no_docs, path, pattern).count() == 0


@pytest.mark.parametrize("words, more", [(8, 1), (14, 2), (24, 5), (64, 15)])
def test_join_finds_pairs_at_the_threshold(spark, words, more):
    """A text and the same with words added, so that the similarity is 0.8 or just above."""
    rng = np.random.default_rng(words)
    rows = []
    for k in range(400):
        text = [f"w{v}" for v in rng.integers(0, 10 ** 9, words + more)]
        assert (words - 4) / (words + more - 4) >= 0.8
        rows += [(2 * k, " ".join(text[:words])), (2 * k + 1, " ".join(text))]
    got = chosen_path.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.class_id == r.doc_id - 1 and r.n_links == 1 for r in got if r.doc_id % 2) >= 0.985 * 400


def test_bpe_of_texts_that_share_id_and_digest(spark, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    args = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    monkeypatch.setattr(bpe, "COMMON_WORDS", 0)
    # the first two have one 32-bit hash; the others differ from them in number and places of words
    texts = ["word 71081 some", "word 293680 some", "word", "word 71081 some", None]
    monkeypatch.setattr(bpe.F, "hash", lambda c: F.lit(7))
    got = bpe.encoded(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), *args).collect()
    assert sorted(r.decoded.decode() for r in got) == sorted(t or "" for t in texts)


def test_words_in_patterns_have_different_hashes(docs):
    bits = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = bits.translate(str.maketrans("ab", "ba"))
    text = f"{bits}\n{other}\n{bits} x"
    piece = next(pieces(pa.array([text, " ".join([bits, other] * 6), " ".join([bits] * 6)])))
    assert len(set(words_of(piece).hash.tolist())) == 3
    features = text_features(piece)
    assert features[3].tolist() == [0, 0, 0] and features[4].tolist() == [0, 12, 6]
    # equal bytes have equal hashes, wherever they are
    data = np.frombuffer(b"xxabcabcab" * 3, np.uint8)
    start, end = np.array([2, 5, 12, 2, 25]), np.array([5, 8, 15, 4, 28])
    hashes = range_hashes(data, start, end).tolist()
    assert hashes[0] == hashes[1] == hashes[2] == hashes[4] != hashes[3]


def test_bpe_with_few_common_words(docs, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    args = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    plain = sorted(map(str, bpe.digests(bpe.encoded(docs, *args)).collect()))
    monkeypatch.setattr(bpe, "COMMON_WORDS", 3)
    monkeypatch.setattr(bpe, "LONG_BYTES", 40)
    assert sorted(map(str, bpe.digests(bpe.encoded(docs, *args)).collect())) == plain


def test_mixture(spark, docs, rows, no_docs):
    slim = docs.select("doc_id", "source", "lang", mixing.topic_of().alias("topic"), mixing.n_tokens().alias("tokens"))
    assert {(r.doc_id, r.tokens) for r in slim.collect()} == {(r[0], len(WORD.findall(r[1] or ""))) for r in rows}
    two = {"source": {"a": 0.5, "b": 0.5}, "lang": 0.0}
    cells = slim.filter("source is not null").groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"))
    raked = mixing.rake(cells, two).collect()
    for dim, shares in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"en": 1 / 3, "fr": 1 / 3, None: 1 / 3})):
        for value, share in shares.items():
            assert sum(r.weight for r in raked if r[dim] == value) == pytest.approx(share, abs=1e-6)
    targets = {"source": 0.5, "lang": 0.7}
    p = mixing.mix_probabilities(slim, targets, 0.6)
    drawn = mixing.with_draw(slim, p, list(targets)).collect()
    assert len(drawn) == len(rows) and all(0 <= r.probability <= 1 for r in drawn)
    total = sum(r.tokens for r in drawn)
    assert sum(r.tokens * r.probability for r in drawn) == pytest.approx(0.6 * total, rel=1e-6)
    everything = mixing.with_draw(slim, mixing.mix_probabilities(slim, targets, 1.0), list(targets)).filter("tokens > 0")
    assert everything.filter("not sampled").count() == 0
    assert mixing.with_draw(no_docs, mixing.mix_probabilities(no_docs.withColumn("tokens", F.lit(1)), targets, 0.5),
                            list(targets)).count() == 0


def test_near_passages(docs, rows, no_docs):
    got = compact_windows.near_passages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    first: dict = {}
    for i, text in first_rows(rows):
        words = WORD.findall(text)
        have = [False] * len(words)
        if i >= 0:
            for span in filter(None, by[i].spans.split(",")):
                s, e = map(int, span.split(":"))
                have[s:e] = [True] * (e - s)
            assert by[i].n_words == len(words) and by[i].n_removed == sum(have)
        for k in range(len(words) - 49):  # every exact repeat of 50 words in an earlier document is found
            key = tuple(words[k:k + 50])
            if first.setdefault(key, i) != i and i >= 0 and len(set(words)) > 20:
                assert all(have[k:k + 50]), (i, k)
    clean = [i for i in by if by[i].class_id == i and not by[i].n_removed]
    assert len(clean) > 30 and sum(r.n_removed > 0 for r in got) >= 15
    assert compact_windows.near_passages(no_docs).count() == 0


def test_near_passages_of_a_middle_document(spark):
    """A passage that repeats one of many slotted versions word for word, neither the first nor the last of them."""
    rng, texts, found = np.random.default_rng(11), [], []
    word = lambda n: ["".join(rng.choice(list("abcdefghijkl"), 7)) for _ in range(n)]
    for case in range(12):
        base, versions = word(66), []
        for _ in range(20):
            version = base.copy()
            version[20], version[45] = word(2)
            versions.append(version)
            texts.append(word(40) + version + word(40))
        texts.append(word(30) + versions[9] + word(30))
        found.append((len(texts) - 1, 30, 96))
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in compact_windows.near_passages(table).collect()}
    for i, s, e in found:
        have = [tuple(map(int, x.split(":"))) for x in got[i].spans.split(",") if x]
        assert any(a <= s and e <= b for a, b in have), (i, have)
        assert got[i].class_id == got[i - 11].class_id


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    text = np.repeat([0, 1, 2], [150, 5, 245])
    at, left, right = compact_windows.windows(text, hashes, 1, 20)
    found = set(zip(at.tolist(), left.tolist(), right.tolist(), strict=True))
    key = (compact_windows.mix(hashes ^ np.uint64(compact_windows.ODD * 2 & (1 << 64) - 1)) & compact_windows.HIGH) | np.arange(400, dtype=np.uint64)
    want = set()
    for lo, hi in ((0, 150), (150, 155), (155, 400)):
        for c in range(lo, hi):
            a = c
            while a > lo and key[a - 1] > key[c]:
                a -= 1
            b = c
            while b + 1 < hi and key[b + 1] > key[c]:
                b += 1
            if b - a + 1 >= 20:
                want.add((c, a, b))
    assert found == want


def test_pipeline(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    current, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        current.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen.append(current.count())
        if name != "bpe":
            assert current.columns == plain.columns
    assert seen == sorted(seen, reverse=True) and seen[0] < plain.count() and seen[-1] == seen[-2] > 20
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, current.collect()))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def plain_rows(rows):
    return Counter(r[:5] for r in rows)


def brute_groups(items, sets):
    """Root of each item; items whose sets have a similarity of 0.8 are linked."""
    parent = {k: k for k in range(len(items))}
    for a in range(len(items)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                unite(parent, a, b)
    return {x: find(parent, k) for k, x in enumerate(items)}


def test_rows_of_quality_stage(spark, docs, plain_rows):
    got = Counter(tuple(r) for r in corpus_pipeline.quality_rules(spark, docs.select(*COLUMNS), "").collect())
    kept = {(r.doc_id, r.text) for r in perplexity.with_verdict(perplexity.scored(docs)).filter("_lm_kept").collect()}
    assert got == Counter({r: n for r, n in plain_rows.items() if (r[0], r[1]) in kept}) and len(got) > 30


def test_rows_of_line_stage(spark, docs, plain_rows):
    got = Counter(tuple(r) for r in corpus_pipeline.line_dedup_stage(spark, docs.select(*COLUMNS), "").collect())
    texts = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in plain_rows})
    lines = sorted({x for _, t in texts for x in t.split("\n") if WORD.search(x)})
    root, seen, left = brute_groups(lines, [plain_shingles(x) for x in lines]), set(), {}
    for i, text in texts:
        kept = []
        for line in text.split("\n"):
            if line not in root or root[line] not in seen:
                kept.append(line)
            seen.add(root.get(line))
        left[i, text] = "\n".join(kept)
    want = Counter()
    for r, n in plain_rows.items():
        text = left[-1 if r[0] is None else r[0], r[1] or ""]
        if text == (r[1] or ""):
            want[r] += n
        elif WORD.search(text):
            want[(r[0], text, *r[2:4], len(text))] += n
    assert {(r[0], r[1], r[4]) for r in got - want if r[0] is not None} == set()
    assert {(r[0], r[1], r[4]) for r in want - got if r[0] is not None} == set()


def test_rows_of_jaccard_stage(spark, docs, plain_rows):
    got = Counter(tuple(r) for r in corpus_pipeline.jaccard_join_stage(spark, docs.select(*COLUMNS), "").collect())
    texts = sorted({r[1] or "" for r in plain_rows})
    words = [WORD.findall(t) for t in texts]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    root, least = brute_groups(texts, sets), {}
    for r in plain_rows:
        if r[0] is not None:
            k = root[r[1] or ""]
            least[k] = min(r[0], least.get(k, r[0]))
    want = {r for r in plain_rows if r[0] is not None and (not WORD.search(r[1] or "") or least[root[r[1] or ""]] == r[0])}
    assert {r for r in got if r[0] is not None} == want and max(got.values()) == 1


def test_rows_of_last_stage(spark, docs, rows):
    pytest.importorskip("public_tokenizers")
    got = Counter((r[0], r[3]) for r in corpus_pipeline.bpe_stage(spark, docs.select(*COLUMNS), "").collect())
    assert got == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


def topic(text):
    if "License" in text:
        return "legal"
    if re.search("[0-9]", text):
        return "figures"
    if re.search(r"[#*$%&|<>!]", text):
        return "markup"
    return "short" if len(text) < 1500 else "long"


def test_rows_of_mixing_stage(spark, docs, plain_rows):
    got = Counter(tuple(r) for r in corpus_pipeline.mixing_stage(spark, docs.select(*COLUMNS), "").collect())
    dims = list(mixing.ALPHAS)
    cell = {r: ({"source": r[3], "lang": r[2], "topic": topic(r[1] or "")}, len(WORD.findall(r[1] or ""))) for r in plain_rows}
    tokens = Counter()
    for r, n in plain_rows.items():
        tokens[tuple(cell[r][0][d] for d in dims)] += n * cell[r][1]
    tokens = {k: n for k, n in tokens.items() if n}
    total = sum(tokens.values())
    weight = {k: n / total for k, n in tokens.items()}
    share = {}
    for i, d in enumerate(dims):
        own = Counter()
        for k, w in weight.items():
            own[k[i]] += w
        flat = {v: w ** mixing.ALPHAS[d] for v, w in own.items()}
        share[d] = {v: w / sum(flat.values()) for v, w in flat.items()}
    for _ in range(500):
        for i, d in enumerate(dims):
            own = Counter()
            for k, w in weight.items():
                own[k[i]] += w
            weight = {k: w * share[d][k[i]] / own[k[i]] for k, w in weight.items()}
    low, high = 0.0, 1e12
    for _ in range(200):
        scale = (low + high) / 2
        used = sum(min(1.0, scale * weight[k] / n) * n for k, n in tokens.items())
        low, high = (scale, high) if used < corpus_pipeline.MIX_BUDGET * total else (low, scale)
    want, unsure = Counter(), Counter()
    for r, n in plain_rows.items():
        k = tuple(cell[r][0][d] for d in dims)
        p = min(1.0, scale * weight[k] / tokens[k]) if k in tokens else 0.0
        name = f"{mixing.SEED}:{'null' if r[0] is None else r[0]}"
        drawn = int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / 2 ** 48
        (unsure if abs(drawn - p) < 1e-6 else want if drawn < p else Counter())[r] += n
    assert want - got == Counter() and got - want - unsure == Counter() and 20 < len(got) < len(plain_rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables_and_clashing_names(spark, docs, no_docs, name, stage):
    pytest.importorskip("public_tokenizers")
    assert stage(spark, no_docs.select(*COLUMNS), "").count() == 0
    wide = docs.withColumns({c: F.lit(c) for c in ("doc", "_id", "_digest", "_removed", "_cell", "topic", "tokens", "weight", "class_id",
                                                    "probability", "sampled", "slot", "ids", "decoded", "removed")})
    plain = Counter(tuple(r) for r in stage(spark, docs.select(*COLUMNS), "").collect())
    got = stage(spark, wide, "")
    if name != "bpe":
        assert got.columns == wide.columns
        got = got.select(*COLUMNS)
    assert Counter(tuple(r) for r in got.collect()) == plain


@pytest.mark.parametrize("size", [300, 1 << 16, (1 << 16) + 1])
def test_bpe_ids_beyond_two_bytes(spark, tmp_path, monkeypatch, size):
    top = size - 1
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": top}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(b) + b" " + str(r).encode() for b, r in ranks.items()))
    for common in (0, 10):  # all words shuffled, or none
        monkeypatch.setattr(bpe, "COMMON_WORDS", common)
        rows = spark.createDataFrame([(1, "ab c ab"), (2, ""), (3, None)], "doc_id long, text string")
        got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.encoded(rows, str(path), r"\w+|\s+").collect()}
        assert got == {1: ([top, 32, 99, 32, top], b"ab c ab"), 2: ([], b""), 3: ([], b"")}


def test_bpe_parts_and_texts_are_small_to_shuffle(spark):
    texts = [f"the quick brown fox {k} jumps over the lazy dog and {k * 7} runs away" * 3 for k in range(3000)]
    base = spark.createDataFrame([(t,) for t in texts], "text string")
    phrases = bpe.common_phrases(base)
    batch = pa.RecordBatch.from_arrays([pa.array(texts[:100])], names=["text"])
    packed = [b.as_py() for out in bpe._pack(spark.sparkContext.broadcast(phrases))([batch]) for b in out.column("text")]
    plain = bpe.zstandard.ZstdCompressor(level=1).compress
    assert sum(map(len, packed)) < 0.8 * sum(len(plain(t.encode())) for t in texts[:100])
    assert bpe.common_phrases(base.limit(1)) == b""
    assert len(bpe._coder({bytes([k]): k for k in range(256)}, r"\w+")("ab")) == 4
