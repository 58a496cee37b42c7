"""Goldens of the profiler, landing, components and change operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import admissions, change, components, identity, rules
from tessera.operators import profile as P
from tessera.sources import landing


def table(spark, names, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "row_number long, " + ", ".join(f"`{n}` string" for n in names))


def facts(spark, names, rows):
    return {r.column: r for r in P.column_facts(table(spark, names, rows)).collect()}


def test_types_and_bounds(spark):
    f = facts(spark, "ndtfbc", [("1", "2024-01-05", "2024-01-05 0:00:00", "1.5", "yes", "A-1"), ("2", "2024-02-05", "2024-01-06T00:00", "2.5", "no", "B.2")])
    assert [f[c].inferred_type for c in "ndtfbc"] == ["int", "date", "timestamp", "decimal", "bool", "code"]
    f = facts(spark, "dn", [("2026-01-05", "5"), ("9999-12-31", "0000"), ("01/15/2024", "-2"), ("1900-01-01", "9999")])
    assert (f["d"].min_value, f["d"].max_value, f["d"].sentinel_count) == ("2024-01-15", "2026-01-05", 2)
    assert (f["n"].min_value, f["n"].max_value, f["n"].sentinel_count) == ("-2", "5", 2)


def test_nulls_keys_and_coverage(spark):
    f = facts(spark, ["plan", "amount"], [("A", "1"), ("A", "2"), ("", "3"), ("A", "")])
    assert f["plan"].null_ratio == 0.25 and f["plan"].constant and f["amount"].max_value == "3"
    rows = table(spark, ["a", "b"], [("1", "2"), ("1", "2"), ("3", "4")])
    assert P.duplicate_rows(rows).first() == (3, 1)
    pair = table(spark, ["x", "y"], [("1", "1"), ("1", "2"), ("2", "1")])
    assert P.candidate_keys(pair, P.column_facts(pair)) == [("x", "y")]
    t = table(spark, ["member_dob", "coverage_start", "coverage_end", "created_at"], [("1990-01-01", "2024-02-01", "2025-01-31", "2026-01-01"), ("1991-01-01", "2024-03-01", "2026-01-31", "2026-01-01")])
    c = P.time_coverage(P.with_roles(P.column_facts(t), [])).first()
    assert (c["columns"], c.from_date, c.to_date) == (["coverage_start", "coverage_end"], "2024-02-01", "2026-01-31")


@pytest.mark.parametrize("name, values, role", [
    ("created_at", ["2024-01-01", "2024-01-02"], "technical"), ("spare", ["", ""], "unclassified"), ("service_date", ["2024-01-01", "2024-01-02"], "date"), ("member_month", ["202401", "202402"], "date"),
    ("provider_npi", ["1", "1"], "identifier"), ("ref", ["A1", "B2"], "identifier"), ("amount", ["1.5", "1.5"], "measure"), ("destination", ["x y", "x y"], "dimension"), ("zip", ["12207", "12207"], "dimension"),
])
def test_roles(spark, name, values, role):
    t = table(spark, [name], [(v,) for v in values])
    f = P.column_facts(t)
    assert P.with_roles(f, P.candidate_keys(t, f) if name == "ref" else []).first().role == role


def test_top_values(spark):
    t = table(spark, ["v"], [(f"v{i}",) for i in range(15)] + [("v14",)])
    top = P.top_values(t).orderBy("rank").collect()
    assert len(top) == 10 and top[0].value == "v14" and top[1].value == "v0"
    assert P.top_values(table(spark, ["city"], [("x",)])).count() == 0


def test_headers_and_files(spark, tmp_path):
    assert landing.clean_header([" a ", "", "a", "a"]) == ["a", "column_2", "a_1", "a_2"]
    assert [landing.sniff(x) for x in ("a|b|c", "a;b", '"x,y";z', "abc", "a\tb")] == ["|", ";", ";", ",", "\t"]
    (tmp_path / "f.csv").write_text("id|name|\n1| Ann |x|extra\n\n|| \n2|Bo\n", encoding="utf-8")
    got = landing.numbered(landing.read_delimited(spark, str(tmp_path / "f.csv"))).orderBy("row_number").collect()
    assert [(r.id, r.name, r.column_3, r.row_number) for r in got] == [("1", "Ann", "x", 1), ("2", "Bo", "", 2)]
    with pytest.raises(ValueError):
        landing.table_name("Bad Name")
    files = landing.new_files(spark, str(tmp_path / "f.csv"), spark.createDataFrame([], "fingerprint string"))
    print_ = files.first().fingerprint
    assert print_.startswith("sha256-") and len(print_) == 39
    assert landing.new_files(spark, str(tmp_path / "f.csv"), files.select("fingerprint")).count() == 0


def test_deliveries_as_they_come(spark, tmp_path):
    """Line breaks in quotes, Latin-1, and files of one folder with other headers, numbered in the order of the files."""
    (tmp_path / "q.csv").write_text('id;note\n1;"two\nlines; one cell"\n2;plain\n', encoding="utf-8-sig")
    assert [(r.id, r.note) for r in landing.read_delimited(spark, str(tmp_path / "q.csv")).orderBy("id").collect()] == [("1", "two\nlines; one cell"), ("2", "plain")]
    (tmp_path / "l.csv").write_bytes("id,name\n1,Zoë\n".encode("latin-1"))
    assert landing.read_delimited(spark, str(tmp_path / "l.csv")).first().name == "Zoë"
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(3)))
    (folder / "b.csv").write_text("id,city\n" + "".join(f"{i},c{i}\n" for i in range(3, 203)))
    got = landing.read_delimited(spark, str(folder))
    assert got.columns == ["id", "name", "city"] and got.where("city = ''").count() == 3
    (tmp_path / "none.csv").write_text("")
    assert landing.read_delimited(spark, str(tmp_path / "none.csv")).count() == 0
    lines = spark.read.schema("v string").option("maxRecordsPerFile", 0).csv(str(folder))
    numbers = [r.v for r in landing.in_file_order(lines).orderBy("row_number").collect()]
    assert numbers == ["id", "0", "1", "2", "id", *map(str, range(3, 203))]


def test_hash_ignores_order_and_null(spark):
    a = spark.createDataFrame([("1", None)], "x string, y string").select(landing.record_hash(["x", "y"])).first()[0]
    b = spark.createDataFrame([("", "1")], "y string, x string").select(landing.record_hash(["y", "x"])).first()[0]
    assert a == b and len(a) == 32


def test_empty_rewrite_clears_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b1"), (2, "b2")], "x int, batch_id string")
    landing.append(rows, str(tmp_path / "t"))
    landing.replace_batch(rows.limit(0), str(tmp_path / "t"), "b1")
    assert [r.x for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [2]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_islands_and_months(spark):
    d = dt.date
    spans = spark.createDataFrame([("m", d(2024, 1, 1), d(2024, 1, 31)), ("m", d(2024, 2, 1), d(2024, 2, 10)), ("m", d(2024, 2, 5), d(2024, 2, 8)), ("m", d(2024, 3, 1), d(2024, 3, 31))], "member string, from_date date, to_date date")
    got = [(r.from_date, r.to_date, r.gap_before) for r in change.merged_spans(spans, ["member"]).orderBy("island").collect()]
    assert got == [(d(2024, 1, 1), d(2024, 2, 10), None), (d(2024, 3, 1), d(2024, 3, 31), 19)]
    assert {r.month: r.days for r in change.member_months(spans, ["member"]).collect()} == {d(2024, 1, 1): 31, d(2024, 2, 1): 10, d(2024, 3, 1): 31}


def test_cancellations_take_back_the_latest(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "g", "A01", t(1)), (2, "g", "A01", t(2)), (3, "g", "A11", t(3)), (4, "g", "A11", t(4)), (5, "g", "A01", t(5)), (6, "g", "A13", t(6)), (7, "g", "A03", t(7))]
    e = spark.createDataFrame(rows, "id int, grp string, event_type string, ts timestamp")
    assert sorted(r.id for r in admissions.without_cancelled(e, "grp", "ts", "id").collect()) == [5, 7]


def test_twins_are_reviewed(spark):
    d = dt.date(2020, 1, 1)
    p = spark.createDataFrame([(1, "ANN", "DOE", d, "12207", "5551234"), (2, "BOB", "DOE", d, "12207", "5551234"), (3, "ANN", "DOE", d, "12207", "5551234")], "id long, first string, last string, dob date, zip string, phone string")
    pairs, over = identity.candidate_pairs(p)
    scored = identity.compared(pairs, p, {"first": 1.0, "last": 4.0, "dob": 4.0, "phone": 2.0}, 0.8, 0.5)
    assert {(r.a, r.b): r.band for r in scored.collect()} == {(1, 2): "review", (2, 3): "review", (1, 3): "auto"} and over.count() == 0
    assert {r.id: r.person_key for r in identity.person_keys(p, scored).collect()} == {1: 1, 2: 2, 3: 1}


def test_rules_respect_exceptions_and_history(spark):
    r = rules.Rule("X", "range", "v", "critical", {"high": 1, "needs_history": True})
    assert rules.action_of(r, {}, "f", 12) == "block" and rules.action_of(r, {}, "f", 1) == "observe" and rules.action_of(r, {("X", "f"): "warn"}, "f", 12) == "warn"
    rows = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    assert [x.verdict for x in rules.flagged(rows, [r]).orderBy(F.col("v").asc_nulls_last()).collect()] == ["pass", "block", "pass"]


def test_guard_without_the_optional_parts(tmp_path):
    """The entry imports and offers the library's own queries where the optional parts are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q); print(set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip() == "True", out.stderr[-500:]
