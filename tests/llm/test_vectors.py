import numpy as np

from signalspark.llm.near_vectors import near_vectors


def brute(rows, threshold=0.95):
    usable = {k: np.array(v, float) for k, (_, v) in enumerate(rows)
              if v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0}
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * len(rows)
    for a, x in usable.items():
        for b, y in usable.items():
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return sorted((r[0], links[k], find(r[0]), find(r[0]) == r[0]) for k, r in enumerate(rows))


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16))
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    rows += [(100 + i, (centers[i % 6] + 0.22 * rng.normal(size=16)).tolist()) for i in range(120)]
    rows += [(300 + i, [1.0, 2.0] * 8) for i in range(9)] + [(320, [2.0, 4.0] * 8)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [None] * 16), (404, [float("nan")] * 16),
             (405, [float("inf")] + [1.0] * 15), (406, [1.0, 0.0]), (407, [1.0, 0.1])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, id string, tile int")
    want = brute(rows)
    for tile in (2048, 16):
        got = near_vectors(df.repartition(3), tile=tile)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[1] for w in want) > 500


def test_empty_and_single(spark):
    kind = "vec_id long, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(5, [1.0])], kind)).collect()] == [(5, 0, 5, True)]
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(5, None)], kind)).collect()] == [(5, 0, 5, True)]
