"""Near duplicates against brute-force Jaccard similarity of five-word shingles."""

import random
from collections import defaultdict

import numpy as np

from tessera.llm import similar


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else {()}


def plain_groups(texts, similarity=0.8):
    """``texts``: id to text. Ids that pairs of similar texts connect."""
    sets = {d: shingles(t) for d, t in texts.items()}
    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    todo, out = set(sets), []
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            d = edge.pop()
            group.add(d)
            for e in set().union(*(where[x] for x in sets[d])) & todo:
                n = len(sets[d] & sets[e])
                if n >= similarity * (len(sets[d]) + len(sets[e]) - n):
                    todo.discard(e)
                    edge.append(e)
        out.append(group)
    return out


def edited(rng, words, share):
    return [rng.choice("zebra lamp cloud river seven".split()) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def fixture(n=60, copies=8):
    """Families of texts whose members differ in up to a tenth of their words."""
    rng, texts = random.Random(3), {}
    for _ in range(n):
        base = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(40, 500))]
        for _ in range(copies):
            texts[len(texts)] = " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04, 0.1])))
    return texts


def test_recall_and_no_false_group(spark):
    texts = fixture()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, rows = similar.classes(docs)
    group = {r.id: r.group for r in rows.select("key.id", "group").collect()}
    pairs = caught = 0
    for g in plain_groups(texts):
        for d in g:
            for e in g:
                if d < e:
                    pairs += 1
                    caught += group[d] == group[e]
    assert pairs > 500 and caught >= 0.95 * pairs
    # Whatever is joined is joined by similar texts.
    of = defaultdict(set)
    for g in plain_groups(texts):
        for d in g:
            of[d] = g
    assert all(e in of[d] for d in texts for e in texts if group[d] == group[e])


def isolated(rng, n, low):
    """Pairs of texts of their own words, alike to ``low`` and more: a tail appended, a block replaced, words substituted."""
    out = []
    while len(out) < n:
        kind = ("tail", "block", "words")[len(out) % 3]
        size, mark = rng.randrange(60, 500), len(out)
        base = [f"t{mark}x{rng.randrange(1 << 30)}" for _ in range(size)]
        fresh = lambda k: [f"u{mark}y{rng.randrange(1 << 30)}" for _ in range(k)]  # noqa: B023, E731
        if kind == "tail":
            other = base + fresh(int(size * rng.uniform(0.1, 0.25)))
        elif kind == "block":
            k = int(size * rng.uniform(0.04, 0.11))
            at = rng.randrange(size - k)
            other = base[:at] + fresh(k) + base[at + k :]
        else:
            other = [fresh(1)[0] if rng.random() < 0.022 else w for w in base]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        alike = len(a & b) / len(a | b)
        if low <= alike < low + 0.05:
            out.append((kind, " ".join(base), " ".join(other)))
    return out


def test_recall_of_isolated_pairs_by_band_and_kind(spark):
    rng = random.Random(8)
    for low in (0.8, 0.85, 0.9):
        pairs = isolated(rng, 240, low)
        docs = spark.createDataFrame([(2 * i + j, t[1 + j]) for i, t in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
        group = {r.id: r.group for r in similar.classes(docs)[1].select("key.id", "group").collect()}
        for kind in ("tail", "block", "words"):
            of = [group[2 * i] == group[2 * i + 1] for i, t in enumerate(pairs) if t[0] == kind]
            assert sum(of) >= 0.95 * len(of) > 70, (low, kind, sum(of), len(of))
        assert len(set(group.values())) >= len(pairs)


def test_one_of_each_group_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in similar.keep_one(docs).collect()}
    assert kept == {min(g): texts[min(g)] for g in plain_groups(texts)}


def test_odd_rows(odd):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    # 1, 2, 3 and the null texts are wordless; 5, 6 and the null id share a text; another text of id 6 stays.
    assert sorted((str(r.doc_id), (r.text or "")[:3]) for r in kept.collect()) == [("1", ""), ("4", "w0 "), ("5", "one"), ("6", "six"), ("9", "naï")]
    assert similar.keep_one(odd.limit(0)).count() == 0


def test_rows_are_kept_by_row(spark):
    a, b = "one two three four five six seven", "other words than those that come before these"
    docs = spark.createDataFrame([(5, a, 1), (6, a, 2), (6, b, 3), (6, b, 4), (None, b, 5), (None, "nobody has these words but this one", 6)], "doc_id long, text string, x int")
    kept = [(r.doc_id, r.text) for r in similar.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (6, b), (None, "nobody has these words but this one")], key=str)


def test_tiles_find_what_one_block_finds(spark, monkeypatch):
    texts = fixture(4, 40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = lambda: sorted(r.id for r in similar.classes(docs)[1].where("first").select("key.id").collect())
    want = group()
    monkeypatch.setattr(similar, "BLOCK", 7)
    assert group() == want


def test_leaders_lose_no_near_member():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    check = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 9)).astype(np.uint64)) for b in base for _ in range(60)])
    joined = lambda edges: {i: min(g) for g in similar_groups(len(check), edges) for i in g}
    pairs, leaders = joined(similar._near(check, 10)), joined(similar._near(check, 10, 5))
    assert all(leaders[i] == leaders[j] for i in range(len(check)) for j in range(i) if pairs[i] == pairs[j])


def similar_groups(n, edges):
    of = {i: {i} for i in range(n)}
    for a, b in edges:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return {id(g): g for g in of.values()}.values()
