import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import counts, packing

P = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def first_fit_decreasing(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        for i, gap in enumerate(bins):
            if gap >= s:
                bins[i] -= s
                break
        else:
            bins.append(capacity - s)
    return len(bins)


def check(docs, capacity):
    t = Tokenizer.from_file(P)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((r.doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = packing.pack(docs, P, capacity, with_ids=True).cache()
    rows = found.collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= 1.02 * first_fit_decreasing([w[3] for w in want], capacity) + 2
    for s in packing.sequences(found).limit(5).collect():
        assert len(s.ids) == 4 * s.n_ids == 4 * sum(length for _, length in held[s.sequence_id])


@pytest.mark.parametrize("capacity", [2048, 300])
def test_pieces_and_places(spark, sf, capacity):
    check(spark.read.parquet(f"{sf}/documents.parquet"), capacity)


def test_odd_rows(spark, odd):
    check(odd, 128)
    assert packing.pack(odd.limit(0), P).count() == 0


def test_best_fit_alone(spark):
    rng = np.random.default_rng(3)
    for sizes, capacity in ((rng.integers(1, 100, 700), 100), ([7] * 300, 10), ([1] * 90, 30), ([60, 40, 50, 50, 30, 70], 100)):
        items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, size long")
        placed = packing.best_fit(items, capacity).collect()
        assert sorted(r.id for r in placed) == list(range(len(sizes)))
        assert len({r.sequence_id for r in placed}) <= 1.02 * first_fit_decreasing(list(sizes), capacity) + 1


def test_counts(spark, sf, odd, monkeypatch):
    t = Tokenizer.from_file(P)

    def same(docs):
        want = []
        for r in docs.select("doc_id", "text").collect():
            n = len(t.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in counts.token_counts(docs, P).collect())

    same(spark.read.parquet(f"{sf}/documents.parquet"))
    same(odd)
    same(odd.limit(0))
    monkeypatch.setattr(counts, "HEAD", 5)
    same(odd)
