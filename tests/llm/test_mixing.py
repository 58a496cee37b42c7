from pyspark.sql import functions as F
from collections import Counter, defaultdict

import re

from tessera.llm import mixing, sharding


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until nothing is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        rest, free = sum(sizes.values()) - sum(fixed.values()), [s for s in names if s not in fixed]
        now = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: cap * sizes[s] for s in free if now[s] >= cap * sizes[s]}
        if not over:
            return fixed | now
        fixed |= over


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = shares(sizes)
    found = mixing.mix(docs, keep=("source",)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in rows)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.kept_source] and abs(r.target - want[r.kept_source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.kept_source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs, keep=("source",)).collect()))


def test_targets_are_met(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_caps_and_odd_rows(spark, odd):
    check(odd)
    assert mixing.mix(odd.limit(0)).count() == 0
    check(spark.createDataFrame([(i, "w " * (1 if i % 7 else 500), f"s{i % 7}") for i in range(70)], "doc_id long, text string, source string"))


def test_positions_follow_the_curve(spark):
    """By time t a source whose weight rises from u to v has met (u t + (v - u) t^2 / 2) / ((u + v) / 2) of its demand."""
    docs = spark.createDataFrame([(i, "w", "b" if i % 2 else "a") for i in range(4000)], "doc_id long, text string, source string")
    found = mixing.mix(docs, weights=(1, 1), curves=((1, 1, 1), (0.5, 1.0, 1.5)), keep=("source",)).collect()
    for t in (0.2, 0.5, 0.9):
        flat = sum(r.position <= t for r in found if r.kept_source == "a") / 2000
        rising = sum(r.position <= t for r in found if r.kept_source == "b") / 2000
        assert abs(flat - t) < 0.01 and abs(rising - (0.5 * t + t * t / 2)) < 0.01


def test_training_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r.copies for r in mixing.mix(docs, whole=True).collect()}
    got = mixing.training_order(docs, docs.columns)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: n for d, n in plan.items() if n})


def exact(docs, n=16):
    rows = docs.select("doc_id", "text").collect()
    found = sharding.shuffle(docs, n).collect()
    counts = Counter(r.shard for r in found)
    assert len(found) == len(rows) and set(counts) <= set(range(n))
    assert not rows or max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
    for s, k in counts.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(k))
    import zlib

    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want


def test_shards_are_exact(spark, sf, odd):
    exact(spark.read.parquet(f"{sf}/documents.parquet"))
    exact(odd)
    exact(odd.limit(0))


def test_matrix_margins_and_law(spark):
    sizes = [137, 0, 5, 1000, 20000, 3, 77]
    blocks = spark.createDataFrame(list(enumerate(sizes)), "block long, n long")
    rows = {r.block: r.counts for r in sharding.matrix(blocks, len(sizes), 5, 3).collect()}
    assert [sum(rows[b]) for b in range(len(sizes))] == sizes
    columns = [sum(r[s] for r in rows.values()) for s in range(5)]
    assert max(columns) - min(columns) <= 1
    # One block of 6 among 12 rows, two shards: the first cell is hypergeometric(12, 6, 6).
    from math import comb

    two = spark.createDataFrame([(0, 6), (1, 6)], "block long, n long")
    draw = sharding._draw("12L", "6L", "6L", "rand(5)")
    got = Counter(r.k for r in spark.range(8000).selectExpr(f"{draw} as k").collect())
    assert all(abs(got[k] / 8000 - comb(6, k) ** 2 / comb(12, 6)) < 0.02 for k in range(7))
    assert sum(r.counts[0] for r in sharding.matrix(two, 2, 2, 1).collect()) == 6


def test_draws_follow_the_law_at_any_size(spark):
    import math

    draw = lambda t, g, p, n: [r[0] for r in spark.range(n).selectExpr(f"(id + 0.5D) / {n} as u", f"{t}L as t", f"{g}L as g", f"{p}L as p").select(F.expr(sharding._draw("t", "g", "p", "u"))).collect()]
    got = draw(20, 8, 5, 4000)
    assert all(abs(got.count(k) / 4000 - math.comb(8, k) * math.comb(12, 5 - k) / math.comb(20, 5)) < 0.001 for k in range(6))
    big = draw(20_000_000_000, 1_250_000_000, 10_000_000_000, 60)
    spread = math.sqrt(1e10 * 0.0625 * 0.9375 * 0.5)
    assert abs(sum(big) / 60 - 625_000_000) < spread / 50 and max(big) - min(big) > 4 * spread
