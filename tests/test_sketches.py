"""Profiles made of batches' states against the exact facts of the whole feed."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import profile, sketches


def test_states_add_up(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, str(i * 7 % 30_011), rng.choice(["", "A", "A", "B", str(int(rng.paretovariate(0.6)) % 5000)]), f"2024-01-{i % 28 + 1:02}" if i % 9 else "9999-12-31", str(i % 77), f"{rng.random():.4f}", "") for i in range(20_000)]
    feed = spark.createDataFrame(rows, "row_number long, claim string, code string, day string, zip string, rate string, spare string")
    for b in range(5):
        sketches.recorded(feed.where(F.col("row_number") % 5 == b), str(tmp_path), f"b{b}")
    files = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if "batch_id=b3" not in str(f)}
    sketches.recorded(feed.where("row_number % 5 = 3"), str(tmp_path), "b3")
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())
    states = spark.read.parquet(str(tmp_path))
    # In two steps or one, whatever the order.
    twice = sketches.merged(sketches.merged(states.where("batch_id < 'b2'")).unionByName(sketches.merged(states.where("batch_id >= 'b2'").drop("batch_id"))))
    for state in (sketches.merged(states), twice):
        got = {r.column: r for r in sketches.told(state).collect()}
        for want in profile.column_facts(feed).collect():
            r = got[want.column]
            same = [c for c in want.asDict() if c not in ("distinct_count", "constant")]
            assert {c: r[c] for c in same} == {c: want[c] for c in same}
            assert abs(r.distinct_count - want.distinct_count) <= r.error * want.distinct_count
        counts = Counter(c for _, _, c, *_ in rows if c)
        most = 1 / (0.75 * sketches.ITEMS) * len(rows)
        assert [t.value for t in got["code"].top[:2]] == [v for v, _ in counts.most_common(2)]
        assert all(counts[t.value] - most <= t.n <= counts[t.value] + most for t in got["code"].top)
        below = sum(float(r[5]) <= got["rate"].median for r in rows) / len(rows)
        assert abs(below - 0.5) <= 0.0165 and got["zip"].top == [] and got["zip"].median is None and got["spare"].top == []
    assert sketches.told(sketches.merged(sketches.profile_state(feed.limit(0)))).count() == 0
