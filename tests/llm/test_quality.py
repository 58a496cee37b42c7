import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality, queries


def test_linear_time_margin_equals_all_pairs():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK))
    index, value = quality.features(b"Some words, and some more words!", 30)
    pairs = sum(v[a] @ v[b] * x * y for i, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[:i])
    assert np.isclose(quality.margin(index, value, w, v), w[index] @ value + pairs)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)
    assert all(r.predicted for r in held if r.quality)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (5, 1, 0), (4, None, 1), (None, 1, 1), (9, 7, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    found = quality.scores(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    none = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.scores(odd, none).collect()} == {0.5}
    assert quality.scores(odd.limit(0), model).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_the_bound_holds(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert set(quality.fit(docs, labels, sample=10)) == {"weights", "factors"}
    again = [quality.fit(docs, labels)["weights"] for _ in range(2)]
    assert (again[0] == again[1]).all() and F is not None
