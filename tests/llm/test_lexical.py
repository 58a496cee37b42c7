import random
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import lexical

P = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def check(docs, capacity):
    """Every id once, in sequences without a gap, full or as long as a power of two."""
    t = Tokenizer.from_file(P)
    ids = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.select("doc_id", "text").collect()]
    rows = lexical.pack(docs, P, capacity).collect()
    held, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0
        held[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    lengths = []
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        lengths.append(at)
    # Only powers of two are shorter, each once at most: nothing is padded.
    short = [n for n in lengths if n != capacity]
    assert max(lengths, default=0) <= capacity and all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    assert sum(lengths) == sum(len(x) for _, x in ids)
    # Rows with one id may have one length: each row's pieces are among them.
    want = Counter(len(x) for _, x in ids)
    assert want == Counter({n: sum(c for (_, m), c in Counter({k: sum(s + x == k[1] for s, x, _ in v) for k, v in parts.items()}).items() if m == n) for n in want})
    by_id = defaultdict(list)
    for d, x in ids:
        by_id[d, len(x)].append(np.array(x, "<u4"))
    for key, pieces in parts.items():
        cover = Counter()
        for start, length, crc in pieces:
            assert any(zlib.crc32(x[start : start + length].tobytes()) == crc for x in by_id[key])
            cover.update(range(start, start + length))
        assert set(cover.values()) == {len(by_id[key])} and len(cover) == key[1]
    return rows


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = check(docs, 2048)
    check(docs, 256)
    # What shares a window is nearer than what does not: of words outside the most frequent, documents of one window share more.
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    common = {w for w, _ in Counter(w for x in texts.values() for w in set(x.lower().split())).most_common(300)}
    words = {d: set(x.lower().split()) - common for d, x in texts.items()}
    windows = defaultdict(set)
    for r in rows:
        windows[r.sequence_id].add(r.doc_id)
    pairs = [(a, b) for w in windows.values() for a in w for b in w if a < b]
    share = lambda ps: sum(len(words[a] & words[b]) / (1 + min(len(words[a]), len(words[b]))) for a, b in ps) / max(len(ps), 1)
    rng = random.Random(1)
    assert share(pairs) > 1.5 * share([tuple(rng.sample(list(texts), 2)) for _ in pairs])


def test_odd_rows(spark, odd):
    check(odd, 128)
    check(odd, 2048)
    assert lexical.pack(odd.limit(0), P).count() == 0
    copies = spark.createDataFrame([(i, "the same words again and again") for i in range(3000)], "doc_id long, text string")
    check(copies, 64)


def plainly(docs, idf, mean, capacity, room):
    """The greedy filling by the formula, document by document."""
    bags = [Counter(d.tolist()) for d in docs]

    def score(q, d):
        norm = 1.2 * (1 - 0.75 + 0.75 * len(docs[d]) / mean)
        return sum(np.float64(np.float32(idf[t] * bags[d][t] * 2.2 / (bags[d][t] + norm))) for t in sorted(bags[q]) if t in bags[d])

    unused, windows, queue = set(range(len(docs))), [[]], []
    while unused or queue:
        if not queue:
            seed = min(unused)
            unused.discard(seed)
            queue = [(seed, 0)]
        seed, start = queue.pop()
        while True:
            take = min(room, len(docs[seed]) - start)
            windows[-1].append((seed, start, start + take))
            room, start = room - take, start + take
            if start == len(docs[seed]):
                break
            windows.append([])
            room = capacity
        for d in sorted(unused, key=lambda d: (-score(seed, d), d)) if room else []:
            if len(docs[d]) > room:
                queue = [(d, 0)]
                unused.discard(d)
                break
            windows[-1].append((d, 0, len(docs[d])))
            unused.discard(d)
            room -= len(docs[d])
            if not room:
                break
        if not room:
            windows.append([])
            room = capacity
    return windows, room


@pytest.mark.parametrize("seed", range(4))
def test_filling_against_plain_version(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.choice(60, rng.integers(1, 40), p=np.arange(60, 0, -1) / 1830) for _ in range(90)] + [np.arange(5)] * 4
    n, idf = len(docs), np.zeros(60)
    for t, k in Counter(t for d in docs for t in set(d.tolist())).items():
        idf[t] = log(1 + (n - k + 0.5) / (k + 0.5))
    mean = sum(map(len, docs)) / n
    for room in (64, 10):
        assert lexical.filled(docs, idf, mean, 64, room) == plainly(docs, idf, mean, 64, room)
