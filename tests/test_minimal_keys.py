"""Minimal keys of a wide feed against all sets of its columns."""

import random
from itertools import combinations

from tessera.operators import profile


def test_wide_feed(spark, monkeypatch):
    rng = random.Random(9)
    n, wide = 400, 11
    columns = [[str(rng.randrange(rng.choice([2, 9, 40, 200]))) for _ in range(n)] for _ in range(wide)]
    columns[3] = [str(i // 20) for i in range(n)]
    columns[10] = [str(i % 20) for i in range(n)]
    columns[7] = [str(i) if i else "" for i in range(n)]
    names = [f"c{i}" for i in range(wide)]
    rows = spark.createDataFrame([(i, *[c[i] for c in columns]) for i in range(n)], ["row_number", *names])
    facts = profile.column_facts(rows).cache()
    held = {c: v for c, v in zip(names, columns, strict=True) if "" not in v}
    want = []
    for size in (1, 2):
        for c in combinations(held, size):
            if len(set(zip(*[held[x] for x in c], strict=True))) == n and not any(set(k) < set(c) for k in want):
                want.append(c)
    assert ("c3", "c10") in want
    for each in (64, 20):
        monkeypatch.setattr(profile, "PER_PASS", each)
        assert profile.minimal_keys(rows, facts, 2) == want
    assert profile.minimal_keys(rows.limit(0), profile.column_facts(rows.limit(0))) == []
