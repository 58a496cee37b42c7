"""Filters of those who read evaluated rows stay above the stages that evaluate them."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import mapping as M
from tessera.plans import core_queries as Q


def longest_filter(df):
    """Letters of the longest filter of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return max((len(line) for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter ")), default=0)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_what_an_entity_leaves_out_is_told_by_outcomes(spark, sf):
    assert 0 < longest_filter(Q.promotion_adjudication(spark, sf)) < 5000


def test_quarantine_is_told_by_outcomes(spark, sf):
    assert 0 < longest_filter(Q.promotion_quarantine(spark, sf)) < 5000


def test_tallies_ask_no_more_than_their_fields(spark, sf):
    """An explode of a column first asks whether it holds anything: that, too, was put below the stages."""
    assert longest_filter(Q.promotion_tallies(spark, sf)) < 1000


def test_tallies_count_each_field(spark, sf):
    done = Q.evaluated(spark, sf)
    want = Counter()
    for r in done.select("fields").collect():
        for f in r.fields:
            stops = f.outcome in M.BLOCKING
            want.update([("failure", f"{f.source}:{f.rule}")] * (stops and f.rule is not None) + [("null_or_invalid", f.target)] * (f.mapped_value is None) + [("affected", f.source)] * stops)
    assert {(r.tally, r["name"]): r.n for r in M.tallies(done).collect()} == want


def test_filtered_rows_are_those_of_all(spark, sf):
    done = Q.evaluated(spark, sf)
    every = {r.row_number: r for r in done.select("row_number", "outcome", "fields").collect()}
    few = done.where("outcome = 'failure' and row_number < 400").where(F.exists("fields", lambda f: f["rule"] == "parse_date"))
    assert longest_filter(few) < 5000
    want = {n for n, r in every.items() if r.outcome == "failure" and n < 400 and any(f.rule == "parse_date" for f in r.fields)}
    assert {r.row_number for r in few.collect()} == want and want


def test_evaluated_rows_meet_themselves_and_others(spark, sf):
    done, other = Q.evaluated(spark, sf), Q.evaluated(spark, sf)
    n = done.count()
    assert done.unionByName(done).count() == done.unionByName(other).count() == 2 * n
    pairs = done.alias("a").join(done.alias("b"), F.col("a.row_number") == F.col("b.row_number"))
    assert pairs.where("a.outcome = b.outcome").count() == done.join(other, "row_number").count() == n
    none = M.evaluate(Q.feed(spark, sf).where("row_number < 0"), Q.SPEC)
    assert M.outcome_counts(none).count() == M.quarantine(none).count() == M.tallies(none).count() == 0


def test_a_stream_is_evaluated(spark, sf, tmp_path):
    Q.feed(spark, sf).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_number long, raw_row map<string,string>").parquet(str(tmp_path / "in"))
    run = M.quarantine(M.evaluate(stream, Q.SPEC)).select("row_number", "outcome").writeStream.format("parquet")
    run = run.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and run.exception() is None
    want = Q.evaluated(spark, sf).where("outcome <> 'ok'").select("row_number", "outcome")
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(want)
