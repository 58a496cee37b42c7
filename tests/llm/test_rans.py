import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import rans

P = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 9), st.integers(1, 5))
def test_round_trip(ids, lanes, every):
    ids = np.array(ids, np.int64)
    coder = rans.Coder(rans.normalised(np.bincount(ids, minlength=1), 12), 12)
    codes, states, marks = coder.encode(ids, lanes, every)
    assert coder.decode(codes, states, marks, len(ids), every).tolist() == ids.tolist()
    for c in range(len(marks)):
        part = coder.decode(codes, states, marks, len(ids), every, only=c)
        assert part.tolist() == ids[c * every * lanes : (c + 1) * every * lanes].tolist()


def test_close_to_entropy():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.02, 400_000), 900)
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    codes, states, _ = rans.Coder(rans.normalised(n)).encode(ids)
    assert len(codes) * 32 + states[:1].size * 64 < 1.08 * -(p * np.log2(p)).sum() * len(ids)


def check(spark, docs):
    path = rans.scratch_path(spark)
    rans.write_tokens(docs, P, path)
    t, want, start = Tokenizer.from_file(P), [], 0
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) as tie").collect()
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie)):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str((*r[:4], bytes(r.ids))) for r in rans.read_tokens(spark, path).collect())
    return path


def test_files(spark, sf, odd, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 5000)
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    check(spark, odd)
    check(spark, odd.limit(0))


def test_damage_is_found(spark, odd):
    path = check(spark, odd)
    blocks = spark.read.parquet(f"{path}/blocks")
    from pyspark.sql import functions as F

    blocks.withColumn("codes", F.unhex(F.regexp_replace(F.hex("codes"), "^..", "00"))).withColumn("crc", F.col("crc") + 1).write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}-bad/table")
    with pytest.raises(Exception, match="damaged"):
        rans.read_tokens(spark, f"{path}-bad").collect()
