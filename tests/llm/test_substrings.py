import hashlib

import pytest

from tessera.llm import substrings
from tessera.llm.words import words


def plain(rows, window=20):
    """``rows``: (doc_id, text) without repeated ids."""
    first, words = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words[d] = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same(docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = substrings.remove_repeats(docs, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == plain(rows, how.get("window", 20))


def test_equals_brute_force(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"))


def test_small_window_and_hot_minimisers(spark):
    """A passage that all documents share with edits, so that its minimisers are dealt over several buckets."""
    import random

    rng = random.Random(1)
    base = [f"p{i}" for i in range(40)]
    rows = []
    for d in range(600):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(40)] = f"x{rng.randrange(9)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(docs, window=6, mmer=2)
    parts = docs.selectExpr("doc_id as doc", "0L as tie", "text")
    some = substrings._sampled(parts, 6, 2)
    assert substrings._hot(some, some.groupBy().sum("n").first()[0], 8)


def test_colliding_hashes_are_told_apart(monkeypatch, spark):
    import numpy as np

    monkeypatch.setattr(substrings, "mixed", lambda x: x * np.uint64(0))
    doc = np.arange(3)
    strings = [b"a b c", b"a b d", b"a b c"]
    spans = substrings._settle(strings, doc, doc * 0, doc * 0, 3, False)
    assert [x.tolist() for x in spans[0][1:5]] == [[2], [0], [0], [3]]


def test_odd_rows(odd, spark):
    same(odd.where("doc_id < 6 or doc_id = 9"))
    found = substrings.remove_repeats(odd, with_text=True, keep=("text",)).collect()
    got = {(r.doc_id, (r.of_text or "")[:3]): r.n_removed for r in found}
    # The first copy repeats itself from its second ten words on; of "six again six again ..." two windows are new.
    assert got[None, "one"] == 50 and got[5, "one"] == 60 and got[6, "one"] == 60 and got[6, "six"] == 58 and got[1, ""] == 0
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_text_without_repeats_stays_as_it_is(odd):
    kept = {r.doc_id: r.kept for r in substrings.remove_repeats(odd, with_text=True, keep=("lang",)).where("doc_id in (1, 3, 9)").collect()}
    assert kept == {r.doc_id: r.text for r in odd.where("doc_id in (1, 3, 9)").collect()}


@pytest.mark.parametrize("texts", [[], [b""], [b"  a  b\t", b"", b"\n", b"b A a" * 3, b"x" * 3_000_000 + b" y"]])
def test_words_are_the_words(texts):
    of, lower = words(texts), words(texts, lower=True)
    want = [t.split() for t in texts]
    raw = of.flat.tobytes()
    assert [raw[a:b] for a, b in zip(of.starts, of.ends, strict=True)] == [w for t in want for w in t]
    assert of.counts.tolist() == list(map(len, want))
    number = of.numbers()
    assert len(set(number.tolist())) == len({w for t in want for w in t}) == len(set(of.hashes().tolist()))
    assert lower.flat.tobytes() == raw.lower()
