"""A crosswalk kept up by deliveries against one made anew from all surviving links."""

import random

from tessera.operators import crosswalk


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_deliveries_equal_recomputation(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "x")
    ids, links, seen = set(), set(), []
    frame = lambda pairs: spark.createDataFrame(list(pairs), "a long, b long")
    for n in range(5):
        fresh = {rng.randrange(120) for _ in range(25)}
        added = {tuple(rng.sample(range(120), 2)) for _ in range(12)} | ({(5, 5)} if n == 1 else set())
        gone = set(rng.sample(sorted(links), min(len(links), 4))) | ({(118, 119)} if n == 2 else set())
        before = dict(seen[-1]) if seen else {}
        wrote = crosswalk.deliver(spark, path, spark.createDataFrame([(i,) for i in [*fresh, None]], "id long"), frame(added), frame(gone))
        links = (links | {tuple(sorted(p)) for p in added if p[0] != p[1]}) - {tuple(sorted(p)) for p in gone}
        ids |= fresh | {i for p in added if p[0] != p[1] and tuple(sorted(p)) not in {tuple(sorted(q)) for q in gone} for i in p}
        want = groups(ids, links)
        got = {r.id: r.person_key for r in crosswalk.labels(spark, path).collect()}
        assert got == want
        # Only those whose key changed are written.
        assert wrote == sum(before.get(i) != k for i, k in want.items())
        seen.append(want)
    for n, want in enumerate(seen, 1):
        assert {r.id: r.person_key for r in crosswalk.labels(spark, path, n).collect()} == want
    assert {(r.a, r.b) for r in crosswalk.links(spark, path).collect()} == links
    # What was not committed is not read.
    (tmp_path / "x" / "commits" / "5").unlink()
    assert {r.id: r.person_key for r in crosswalk.labels(spark, path).collect()} == seen[-2]
    assert crosswalk.labels(spark, str(tmp_path / "none")).count() == 0
