"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The fixed patterns give the base spans, which always stay. The random field scores
whole candidate segments of up to ``MAX_WORDS`` words as one of the kinds (digits,
check sums, shape, alphabet, randomness, neighbouring words), single words also as
none, and dynamic programming over segment ends picks boundaries and kinds
together. Segments are looked for around words that hold a digit or ``@``; elsewhere
every word is none. A span that it finds is added if it overlaps no base span.

The field is trained on ``TRAIN_DOCS`` documents at most, those of the least digest
among the ones with such words: the base spans, and keys and passwords by the seed
patterns below, are its labels. Everything else covers all rows and whole texts.
Null texts are empty; a table without labels adds no spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LABELS = ("none", *ALL_KINDS)
TRAIN_DOCS = 2000
MAX_WORDS = 4
EPOCHS = 4
#: Least probability of a segment that is added.
CERTAIN = 0.9

AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match cannot begin inside a run of digits, so skipping such starts only saves time
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SECRET = re.compile(r"AKIA[0-9A-Z]{16}|password=[^\s]{8,}|(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])")
SUSPECT = re.compile(r"[^\s]*[0-9@][^\s]*")
WORD = re.compile(r"[^\s]+")
TRIM = ".,;:!?\"'()[]{}<>#$%&*|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = AFTER_AT.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]], kinds=ALL_KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def chunks(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Words (start, end, word) around suspicious ones: these and a neighbour on either side."""
    group: list[tuple[int, int, str]] = []
    last = -1
    for m in SUSPECT.finditer(text):
        before = max(text.rfind(" ", 0, max(m.start() - 1, 0)) + 1, last, m.start() - 40, 0)
        new = [(w.start(), w.end(), w.group()) for w in WORD.finditer(text, before, m.start())][-1:]
        if group and new and new[0][0] > last:
            after = WORD.search(text, last)
            if after and after.start() < new[0][0]:
                yield [*group, (after.start(), min(after.end(), after.start() + 40), text[after.start():after.end()][:40])]
                group = []
        elif group and not new and m.start() - last > 60:
            yield group
            group = []
        group += [w for w in new if w[0] >= last] + [(m.start(), m.end(), m.group())]
        last = m.end()
    if group:
        after = WORD.search(text, last)
        yield [*group, (after.start(), after.end(), after.group()[:40])] if after else group


def features(words: list[tuple[int, int, str]], i: int, j: int) -> list[str]:
    """Features of the whole segment words[i:j]."""
    s = " ".join(w[2] for w in words[i:j])
    core = s.strip(TRIM)[:200]
    digits = "".join(c for c in core if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in core)
    n = len(digits)
    out = ["bias", f"words{j - i}", f"digits{'0' if not n else 'a' if n < 4 else 'b' if n < 9 else 'c' if n < 12 else 'd' if n < 16 else 'e' if n < 20 else 'f'}"]
    if letters == 0 and 12 <= n <= 19 and CARD.fullmatch(core):
        out.append("luhn" if luhn(digits) else "noluhn")
    if IP.fullmatch(core):
        out.append("octets" if all(int(p[:4]) <= 255 for p in core.split(".")) else "badoctets")
    if core.startswith("+"):
        out.append("plus")
        if letters == 0 and 9 <= n <= 15:
            out.append("plusnumber")
    if "@" in core:
        name, _, host = core.partition("@")
        out.append("mail" if name and AFTER_AT.fullmatch(host) else "at")
    if "=" in core:
        out.append("assigned")
    if letters and n:
        out.append("mixed")
        if all(c in "0123456789abcdef" for c in core):
            out.append("hex32" if len(core) >= 32 else "hex")
        if all(c.isupper() or c.isdigit() for c in core):
            out.append("capitals16" if len(core) >= 16 else "capitals")
        counts = Counter(core)
        spread = -sum(k / len(core) * math.log2(k / len(core)) for k in counts.values())
        out.append(f"spread{min(int(spread), 5)}")
    out.append(f"size{min(len(core) // 4, 10)}")
    if not any(DIGIT.search(w[2]) or "@" in w[2] for w in (words[i], words[j - 1])):
        out.append("plainends")
    elif j - i > 1 and not all(DIGIT.search(w[2]) or "@" in w[2] for w in (words[i], words[j - 1])):
        out.append("plainend")
    if any(not DIGIT.search(w[2]) for w in words[i:j]):
        out.append("someplain")
    if i and words[i - 1][2].lower().strip(TRIM + "=") in ("password", "token", "key", "secret", "api_key"):
        out.append("cue")
    return out


class SemiMarkov:
    """Weights per feature and label, with exact inference over segmentations of a chunk."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}

    def _score(self, names: list[str]) -> np.ndarray:
        total = np.zeros(len(LABELS))
        for f in names:
            if f in self.weights:
                total = total + self.weights[f]
        return total

    def lattice(self, words) -> dict[tuple[int, int], tuple[list[str], np.ndarray]]:
        """Features and label scores of every segment; only single words can be none."""
        out = {}
        for i in range(len(words)):
            for j in range(i + 1, min(i + MAX_WORDS, len(words)) + 1):
                names = features(words, i, j)
                score = self._score(names)
                if j - i > 1:
                    score = np.concatenate([[-np.inf], score[1:]])
                out[i, j] = names, score
        return out

    def sums(self, lattice, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over all segmentations up to, and from, every boundary."""
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        whole = {k: float(np.logaddexp.reduce(v[1])) for k, v in lattice.items()}
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[i] + whole[i, j] for i in range(max(0, j - MAX_WORDS), j)])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([whole[i, j] + backward[j] for j in range(i + 1, min(i + MAX_WORDS, n) + 1)])
        return forward, backward

    def fit(self, examples: list[tuple[list, dict[tuple[int, int], int]]], rate: float = 0.5) -> None:
        """Likelihood ascent with adaptive steps over chunks and their labelled segments."""
        power: dict[str, np.ndarray] = {}
        for _ in range(EPOCHS):
            for words, gold in examples:
                n = len(words)
                lattice = self.lattice(words)
                forward, backward = self.sums(lattice, n)
                step: dict[str, np.ndarray] = {}
                covered = {k for i, j in gold for k in range(i, j)}
                truth = {**gold, **{(k, k + 1): 0 for k in range(n) if k not in covered}}
                for (i, j), (names, score) in lattice.items():
                    move = -np.exp(forward[i] + score + backward[j] - forward[n])
                    if (i, j) in truth:
                        move[truth[i, j]] += 1
                    if np.abs(move).max() > 1e-4:
                        for f in names:
                            step[f] = step.get(f, 0) + move
                for f, g in step.items():
                    power[f] = power.get(f, 1e-3) + g * g
                    self.weights[f] = self.weights.get(f, 0) + rate * g / np.sqrt(power[f])

    def best(self, words) -> list[tuple[int, int, int]]:
        """(first word, end word, label) of the best segmentation's segments that are sure enough."""
        n = len(words)
        lattice = self.lattice(words)
        score, back = np.full(n + 1, -np.inf), [(0, 0)] * (n + 1)
        score[0] = 0.0
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_WORDS), j):
                label = int(np.argmax(lattice[i, j][1]))
                if score[i] + lattice[i, j][1][label] > score[j]:
                    score[j], back[j] = score[i] + lattice[i, j][1][label], (i, label)
        out, j = [], n
        forward = backward = None
        while j:
            i, label = back[j]
            if label:
                if forward is None:
                    forward, backward = self.sums(lattice, n)
                if forward[i] + lattice[i, j][1][label] + backward[j] - forward[n] >= math.log(CERTAIN):
                    out.append((i, j, label))
            j = i
        return out[::-1]


def labelled(text: str) -> list[tuple[list, dict[tuple[int, int], int]]]:
    """Chunks of a text with the segments that base and seed patterns mark."""
    spans = [(s, e, k + 1) for s, k, e in base_spans(text)]
    spans += [(m.start(), m.end(), len(LABELS) - 1) for m in SECRET.finditer(text)
              if not any(s < m.end() and m.start() < e for s, e, _ in spans)]
    out = []
    for words in chunks(text):
        gold: dict[tuple[int, int], int] = {}
        taken: set[int] = set()
        for s, e, label in spans:
            inside = [k for k, w in enumerate(words) if w[0] < e and s < w[1]]
            if inside and len(inside) <= MAX_WORDS and not taken & set(inside):
                gold[inside[0], inside[-1] + 1] = label
                taken.update(inside)
        if len(words) <= 60:
            out.append((words, gold))
    return out


def train(docs: DataFrame, text_col: str = "text", limit: int = TRAIN_DOCS) -> SemiMarkov:
    """Field fitted on the ``limit`` documents of least digest that have suspicious words."""
    some = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") < 20_000))
    # about twice as many as wanted pass, so that tasks do not each send ``limit`` texts to the driver
    slot = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    share = min(1.0, 2 * limit / max(some.count(), 1))
    rows = some.filter(slot < int(share * (1 << 20)) + 1).orderBy(slot, "text").limit(limit).collect()
    field = SemiMarkov()
    field.fit([x for r in rows for x in labelled(r[0])])
    return field


def all_spans(text: str, field: SemiMarkov) -> tuple[list, list]:
    """Base spans, and all spans with those that the field adds."""
    base = base_spans(text)
    if not (DIGIT.search(text) or "@" in text):
        return base, base
    added = []
    for words in chunks(text):
        for i, j, label in field.best(words):
            s, e = words[i][0], words[j - 1][1]
            while s < e and text[s] in TRIM:
                s += 1
            while e > s and text[e - 1] in TRIM:
                e -= 1
            if s < e and not any(a < e and s < b for a, _, b in base):
                added.append((s, label - 1, e))
    return base, sorted(base + added)


def _find(shared):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            out = []
            for t in batch.column("text"):
                base, spans = all_spans(t.as_py() or "", field)
                n = Counter(k for _, k, _ in base)
                out.append((*[n[k] for k in range(len(KINDS))], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    return step


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SemiMarkov | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; spans are kind:start:end in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _find(shared), schema).withColumnRenamed("id", id_col)
