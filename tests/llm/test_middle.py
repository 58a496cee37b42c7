import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    found = middle.fill_in_middle(docs)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(plainly(r.doc_id, r.text)) for r in rows)
    back = found.select("doc_id", middle.restored().alias("text")).collect()
    assert sorted(map(str, back)) == sorted(str(r) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_against_plain_version(spark, block, monkeypatch):
    monkeypatch.setattr(middle, "BLOCK", block)
    rng = random.Random(block)
    alphabet = "abYZ <>PSM.\n\x00é日😀" + "word" * 4
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 40, 900]))) for _ in range(120)]
    texts += ["a" * 5000, "<<P", "<P>", "x<S>y", "a<M>", "<", "é" * 3000, "日" * 2000 + "z" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Workers import the module anew: the block goes to the plain classes here, to the operator with its own.
    for text in texts:
        raw = text.encode()
        units = middle.Units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        tree, n = units.of(0)
        want = UNIT.findall(text)
        assert n == len(want)
        for k in {0, 1, n // 2, n - 1, n} & set(range(n + 1)):
            head = "".join(want[:k])
            assert units.cut(0, tree, k) == (len(head.encode()), len(head))
    check(docs)


def test_documents_and_odd_rows(spark, sf, odd):
    check(spark.read.parquet(f"{sf}/documents.parquet"))
    check(odd)
    assert middle.fill_in_middle(odd.limit(0)).count() == 0
