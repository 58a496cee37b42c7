import math

from tessera.llm import vectors

NAN, INF = float("nan"), float("inf")


def brute(rows, every, k, zero, convert):
    fine = [(i, [convert(float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    asked = {}
    for i, v in fine:
        if i % every == 0 and (i not in asked or v < asked[i]):
            asked[i] = v
    out = []
    for q, v in asked.items():
        scores = [(-math.fsum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def odd(spark):
    base = [[math.sin(i * j + i * i) for j in range(1, 9)] for i in range(70)]
    rows = [(i, v) for i, v in enumerate(base)] + [(200 + i, base[3]) for i in range(12)] + [(20, base[9]), (20, base[8]), (40, base[40])]
    rows += [(300, None), (301, []), (302, [NAN] * 8), (303, [INF, *[0.0] * 7]), (304, [None, *[1.0] * 7]), (305, [0.0] * 8), (None, base[1]), (320, [1.0, 2.0]), (321, [2.0, 1.0])]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string")


def floats(spark, rows):
    import numpy as np

    return [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_exact_top_k(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, 50, 5, True, lambda x: math.floor(256 * x))
    for how in ({}, {"slices": 3, "lane": 40, "block": 2}):
        assert sorted(map(tuple, vectors.top_inner(table, **how).collect())) == sorted(want)


def test_exact_top_k_odd_rows(spark):
    rows, table = odd(spark)
    want = brute(floats(spark, rows), 20, 5, True, lambda x: math.floor(256 * x))
    assert sorted(map(tuple, vectors.top_inner(table, every=20).collect())) == sorted(want)
    assert sorted(map(tuple, vectors.top_inner(table, every=20, lane=9, slices=4).collect())) == sorted(want)
    assert vectors.top_inner(table.limit(0)).count() == 0


def recall(found, want):
    got = {(r.query_id, r.vec_id) for r in found}
    return sum((q, i) in got for q, _, i, _ in want) / len(want)


def test_nearest_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, 20, 20, False, float)
    for how in ({}, {"lane": 60, "block": 5}):
        found = vectors.nearest(table, **how).collect()
        assert recall(found, want) >= 0.98 and len(found) == len(want)
        exact = {(q, i): s for q, _, i, s in brute(rows, 20, 500, False, float)}
        assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in found)


def test_nearest_odd_rows(spark):
    rows, table = odd(spark)
    want = brute(floats(spark, rows), 20, 20, False, float)
    found = vectors.nearest(table).collect()
    assert len(found) == len(want) and recall(found, want) >= 0.9
    by = sorted(found, key=lambda r: (r.query_id, r["rank"]))
    assert all(a.query_id != b.query_id or (-a.score, a.vec_id) <= (-b.score, b.vec_id) for a, b in zip(by, by[1:]))
    assert vectors.nearest(table.limit(0)).count() == 0
