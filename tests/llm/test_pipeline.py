"""Each stage against a plain version of its decision, on what the stage before it kept."""

import importlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality
from tessera.plans.scratch import written
from tests.llm.test_similar import plain_groups

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        kept[name] = docs
        assert name == "packing" or docs.columns == columns
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(whole, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.scores(whole, model).collect() if r.score >= 0.3}
    first = {r.doc_id: r.text for r in kept["quality"].collect()}
    assert set(first) == good and len(good) > 0.7 * whole.count()

    left = {min(g) for g in plain_groups(first)}
    second = {r.doc_id: r.text for r in kept["near_duplicates"].collect()}
    assert second == {d: first[d] for d in left}

    third = {r.doc_id: r for r in kept["repeated_passages"].collect()}
    seen, want = {}, {}
    for d in sorted(second):
        w = second[d].encode().split()
        gone = set()
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (d, i)) != (d, i):
                gone |= set(range(i, i + 20))
        want[d] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else second[d]
    assert {d: r.text for d, r in third.items()} == want
    assert all(len(r.text) == r.n_chars for r in third.values())

    plan = {r.doc_id: r.copies for r in mixing.mix(kept["repeated_passages"], whole=True).collect()}
    fourth = Counter(r.doc_id for r in kept["mixture"].collect())
    assert fourth == Counter({d: n for d, n in plan.items() if n})
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in third.values())
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", third[d].text)) * n for d, n in fourth.items())
    assert abs(taken - words) < 0.1 * words

    pieces = kept["packing"].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == fourth
    full = Counter()
    for r in pieces:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048


def test_run_takes_odd_tables(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (4, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() >= 1
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert importlib.util.find_spec("corpus_pipeline")


def test_columns_with_clashing_names(spark, odd):
    names = ["position", "kept", "n_words", "n_removed", "sha256", "of_text", "c", "group", "tie", "turn", "spans", "at", "_row"]
    docs = odd.withColumns({n: F.lit(n) for n in names})
    for stage in (pipeline.near_duplicates, pipeline.repeated_passages, pipeline.mixture):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(names).collect()} == {tuple(names)}
