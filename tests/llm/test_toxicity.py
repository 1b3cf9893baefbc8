"""The recurrent network against differences and plain loops, and its verdicts on held-out texts."""

import random
import zlib

import numpy as np

from signalspark.llm import gru, toxicity

WORDS = ["ab", "größe", "x", "toxicword", "日本語", "alongerword", "ab"]


def doubled(seed=4):
    return {k: v.astype(float) for k, v in gru.fresh(seed).items()}


def test_hashes_depend_on_the_word_alone():
    every = gru.hashed(["ab", "b", "abc", "日本", "ab"])
    alone = [gru.hashed([w]) for w in ["ab", "b", "abc", "日本", "ab"]]
    parts = [sorted(every.gram[s:s + n]) for s, n in zip(every.start, every.count)]
    assert parts == [sorted(a.gram) for a in alone]
    assert every.word.tolist() == [int(a.word[0]) for a in alone]
    assert every.count.tolist() == [4, 2, 7, 4, 4]  # ab: ^ab, ab$, ^ab$ and the whole


def test_forward_equals_plain_loops():
    p = doubled()
    words, windows, first = toxicity.prepared(["ab größe x toxicword", "", "x " * 70 + "日本語 alongerword"])
    g = gru.projected(p, gru.inputs(p, gru.hashed(words)))
    got, _ = gru.forward(p, g, windows)
    s, h = (lambda v: 1 / (1 + np.exp(-v))), gru.HIDDEN

    def run(d, ids):
        state, out = np.zeros(h), []
        for i in ids:
            x, y = g[d, i], state @ p["u"][d]
            z, r = s(x[:h] + y[:h]), s(x[h:2 * h] + y[h:2 * h])
            state = (1 - z) * np.tanh(x[2 * h:] + r * y[2 * h:]) + z * state
            out.append(state)
        return out
    for ids, value in zip(windows, got):
        both = [np.concatenate(v) for v in zip(run(0, ids), run(1, ids[::-1])[::-1])]
        real = [b for b, i in zip(both, ids) if i < len(words)]
        e = np.exp([np.tanh(b @ p["wa"] + p["ba"]) @ p["va"] for b in real])
        pooled = sum((w / e.sum() * b for w, b in zip(e, real)), np.zeros(2 * h))
        assert np.isclose(pooled @ p["wo"] + p["bo"][0], value)
    # every word is in a window, and windows overlap
    assert toxicity.windows_of(72).tolist() == [0, 16, 32, 40] and first.tolist() == [0, 1, 2]
    assert toxicity.windows_of(32).tolist() == [0] and toxicity.windows_of(0).tolist() == [0]


def test_gradients_equal_differences():
    p = doubled()
    words, windows, first = toxicity.prepared([" ".join(WORDS), "x ab", "größe " * 50, ""])
    labels = np.array([1, 0, 1, 0])
    _, grad = toxicity.loss_and_gradient(p, words, windows, first, labels)
    rng = np.random.default_rng(0)
    assert set(grad) == set(p)
    for name, d in grad.items():
        some = list(zip(*np.nonzero(d))) or [(0,) * d.ndim]
        for at in (some[i] for i in rng.integers(0, len(some), 6)):
            loss = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += step
                loss.append(toxicity.loss_and_gradient(moved, words, windows, first, labels)[0])
            assert np.isclose((loss[0] - loss[1]) / 2e-5, d[at], rtol=1e-4, atol=1e-8), (name, at)


def made(n, seed):
    """Documents of which a third have words of one of two toxic stems, most endings seen once only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeionrstl") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(2, 50))]
        bad = k % 3 == 0
        for _ in range(2 * bad):
            words[rng.randrange(len(words))] = rng.choice(["Vexo", "grumph"]) + word()
        rows.append((k, " ".join(words), "en", 1, 0.5, "x"))
        labels.append((k, int(bad), "y"))
    return rows, labels


def test_held_out_texts(spark):
    rows, labels = made(600, 7)
    rows += [(None, None, None, 1, 0.5, "x"), (9001, None, None, 1, 0.5, "x"), (9002, "", None, 1, 0.5, "x"), rows[0],
             (9003, "ao " * 30_000 + "vexoring", None, 1, 0.5, "x"), (9004, "日" * 5000, None, 1, 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, score double, id string").repartition(3)
    known = spark.createDataFrame(labels + [(None, 1, "y"), (3, None, "y"), (12345, 1, "y")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    truth = {k: t for k, t, _ in labels}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # a toxic word at the end of a very long text counts; texts without words are clean
    last = {r.doc_id: r for r in found}
    assert last[9003].predicted == 1 and not any(last[k].predicted for k in (None, 9001, 9002))
    # scores do not depend on labels of held-out rows, nor on their neighbours
    flipped = spark.createDataFrame([(k, t if zlib.crc32(str(k).encode()) % 5 else 1 - t, "y") for k, t, _ in labels],
                                    "doc_id long, toxic int, text string")
    samples = [toxicity.training_sample(docs, k, "toxic", "doc_id", "text").orderBy("_id").collect() for k in (known, flipped)]
    assert samples[0] == samples[1] and len(samples[0]) == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k, _, _ in labels)


def test_no_labels(spark, no_docs):
    rows, _ = made(5, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, score double, id string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    clean = spark.createDataFrame([(k, 0) for k in range(5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, clean).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, none).collect() == []
