"""What is told of cells: once a cell, below the aggregates, and the same as parsers by pattern tell."""

import re

from pyspark.sql import functions as F

from tessera.functions.scalars import text_shape
from tessera.operators import profile, sketches


def test_values_are_matched_and_parsed_below_the_aggregates(spark):
    rows = spark.createDataFrame([(1, "1", "2024-01-05"), (2, "", "x")], "row_number long, claim string, zip string")
    for df in (sketches.profile_state(rows), profile.column_facts(rows)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        states = [line for line in plan.splitlines() if re.search(r"Aggregate \[position#\d+, column#\d+\]", line)]
        assert states and not any(re.search(r"RLIKE|gettimestamp|cast\(value", line) for line in states)
    # Whether a column is protected is told of its name, not of each cell.
    assert "RLIKE(replace" not in sketches.profile_state(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_days_are_those_of_parsers_by_pattern(spark):
    days = [f"{y}-{m:02}-{d:02}" for y in ("0000", "0001", "1582", "1900", "2023", "2024", "9999") for m in (0, 1, 2, 4, 12, 13) for d in (0, 1, 9, 10, 28, 29, 30, 31, 32)]
    days += [d.replace("-", "") for d in days] + [f"{a}{x}{b}{y}{year}" for a in ("0", "1", "01", "2", "12", "13", "001") for b in ("0", "5", "05", "29", "30", "31", "32") for x in "/-" for y in "/-" for year in ("2024", "0000", "24", "12024")]
    days += [f"2024-02-29{t}" for t in (" 1:00", "T01:00:00Z", " 1", " 1:0", "T", " 25:99", "\n", "x 1:00", "  10:00")] + ["", " ", "\n", "2024-01-05 ", " 2024-01-05", "\t2024-01-05", "2024-01-05\n", "20240105\n", "1/5/2024\n", "2024-1-5", "202401051", "２０２４-01-05", "2024-01-0５", "+2024-01-05", "2023-02-29 10:00", "2024-13-01T10:00"]
    v = F.col("v")
    t = F.trim(v)
    text = F.when(t.rlike(profile.TIMESTAMP), F.left(t, F.lit(10))).otherwise(t)
    first, *rest = [F.to_date(F.when(text.rlike(text_shape(f)), F.try_to_timestamp(text, F.lit(f)))) for f in ("yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "yyyyMMdd")]
    got = spark.createDataFrame([(d,) for d in days], "v string").select("v", profile.iso_date(v).cast("string").alias("got"), F.coalesce(first, *rest).cast("string").alias("want")).collect()
    assert [r for r in got if r.got != r.want] == [] and sum(r.got is not None for r in got) > 100


def test_lengths_let_through_what_matches(spark):
    odd = ["0", "-0", "+1", "1.5", ".5", "5.", "-.5", "1.5\n", "1\n", "1\r\n", "1 ", "20240105 ", "12/31/2024 ", "ABCDEFGHIJKLMNOP ", "ABCDEFGHIJKLMNOPQ", "TRUE", "False", "yes ", "NO", "ﬀ", "0000", "00000\n", " 9999 ", "9999-12-31", " 1900-01-01 00:00:00 ", "12/31/9999", "01/01/1900", "0000-00-00", "99", "2024-01-05 1:00", "2024-01-05T10:00:00.000Z", "", " ", "é" * 9, "A.B_C-1"]
    v = F.col("value")
    want = {"int": v.rlike(profile.INT), "decimal": v.rlike(profile.DECIMAL), "dated": v.rlike(profile.DATE), "stamp": v.rlike(profile.TIMESTAMP), "bool": F.lower(v).isin(*profile.BOOL), "code": v.rlike(profile.CODE), "sentinel": profile.is_sentinel(v)}
    cells = profile.looked_at(spark.createDataFrame([(x,) for x in odd], "value string"))
    assert not cells.withColumns({f"want_{c}": e for c, e in want.items()}).where(" or ".join(f"`{c}` <> want_{c}" for c in want)).collect()
