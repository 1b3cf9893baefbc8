"""The Merkle manifest against hashlib, one tree at a time."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from signalspark.llm import merkle

KINDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, size int, block int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def paths(nodes):
    """Root of ``nodes`` and, per node, (left, right) siblings of every level."""
    found = [[] for _ in nodes]
    own = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(found, own):
            run = nodes[at - at % 3:at - at % 3 + 3]
            path.append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
        own = [at // 3 for at in own]
        nodes = [h(nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], found


def fold(node, path):
    for left, right in path:
        node = h([left, node, right])
    return node


def brute_force(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [paths([leaf(r) for r in g]) for g in groups]
    root, tops = paths([t[0] for t in trees])
    for g, (subroot, below), top in zip(groups, trees, tops):
        for r, path in zip(g, below):
            path = path + top
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            changed = r if odd or r[4] is None else (*r[:4], r[4].replace("\n", ""))
            yield r[0], leaf(r), subroot, root, h(a + b for a, b in path), fold(leaf(changed), path)


def made(sizes):
    rows = [(k * 7 % 1009, s, None if k % 5 else "en", None if k % 7 == 0 else k, None if k % 11 == 0 else f"é{k}\n" * (k % 4))
            for s, n in sizes.items() for k in range(n)]
    return rows + rows[:2]


GROUPS = {"a": 1, "": 3, None: 10, "é": 244, "z": 30, "-": 81}


@pytest.mark.parametrize("step, sizes", [(5, {None: 1}), (1, GROUPS), (5, GROUPS), (2, {f"s{k}": 1 + k % 3 for k in range(50)})])
def test_manifest(spark, monkeypatch, step, sizes):
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [r for r in made(sizes)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS).repartition(3)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.manifest(docs, tampered={"text": text})
    shown = sorted(got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect())
    assert [tuple(r) for r in shown] == sorted(brute_force(rows))
    # a path alone proves its leaf
    assert all(fold(r.leaf, r.path) == r.root for r in got.collect())


def test_edge_rows(spark, docs, rows, no_docs):
    want = sorted(brute_force([(r[0], r[3], r[2], r[4], r[1]) for r in rows]), key=str)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.manifest(docs, tampered={"text": text}, with_path=False)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert merkle.manifest(no_docs).collect() == []
