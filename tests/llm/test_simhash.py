from collections import defaultdict

import xxhash

from tessera.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def same(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = simhash.groups(docs).withColumn("fp", simhash.hex16("fp")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_groups_equal_brute_force(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(odd):
    same(odd)
    same(odd.limit(0))


def test_links_are_all_found(spark):
    import random

    rng = random.Random(5)
    some = [rng.getrandbits(64) for _ in range(20)]
    near = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for x in some for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for radius, segments in ((3, 2), (5, 3), (7, 4)):
        found = simhash.links(spark.createDataFrame([(signed(x),) for x in near], "fp long"), radius, segments).distinct().collect()
        want = {(a, b) for a in map(signed, near) for b in map(signed, near) if a < b and (a % 2**64 ^ b % 2**64).bit_count() <= radius}
        assert {tuple(r) for r in found} == want
