"""Sets with repeats are told by a share of their values; a single repeat anywhere is still found."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import profile


@pytest.mark.parametrize("again", [0, 1, 7, 2_999])
def test_one_repeat_is_found(spark, again):
    rows = spark.range(3_000).select(F.col("id").alias("row_number"), F.floor(F.col("id") / 60).cast("string").alias("a"), (F.col("id") % 60).cast("string").alias("b"))
    facts = profile.column_facts(rows).cache()
    assert profile.minimal_keys(rows, facts, 2) == [("a", "b")]
    twice = rows.union(rows.where(F.col("row_number") == again))
    assert profile.minimal_keys(twice, profile.column_facts(twice), 2) == []


def test_only_what_may_be_a_key_is_looked_at_whole(spark, monkeypatch):
    whole, standing = [], profile._standing
    monkeypatch.setattr(profile, "_standing", lambda rows, sets, n, share: whole.extend(sets if share == 1 else []) or standing(rows, sets, n, share))
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("row_number"), *[F.pmod(F.xxhash64(F.lit(c), F.col("id")), F.lit(3_000)).cast("string").alias(c) for c in "abc"], F.floor(F.col("id") / 2).cast("string").alias("d"), (F.col("id") % 2).cast("string").alias("e"))
    keys = profile.minimal_keys(rows, profile.column_facts(rows), 2)
    assert ("d", "e") in keys and ("a", "b") not in whole and set(keys) <= set(whole)
