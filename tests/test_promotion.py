"""The row-level goldens of mapping and promotion."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import mapping as M
from tessera.sources import landing as L

ROSTER = [
    ("K-7301", "Ottoline", "1963-02-28", "F", "otto@mail.test", "Quimper", "0298-11"),
    ("K-7302", "Baptiste", "1971-31-12", "M", "bap@mail.test", "Vannes", "0297-12"),
    ("K-7303", "Wenna", "1988-06-30", "N", "wenna@mail.test", "Morlaix", "0298-13"),
    ("", "Corentin", "1990-10-09", "M", "cor@mail.test", "Lorient", "0297-14"),
    ("K-7305", "Maelle", "2004-12-01", "F", "", "", ""),
]
NAMES = ["member_id", "member_first_name", "member_dob", "member_sex", "member_email", "member_city", "member_phone"]
SPEC = M.Spec("silver_raw.members", (
    M.Field("member_id", "members.source_system_id", on_null="reject"), M.Field("member_first_name", "members.first_name"),
    M.Field("member_dob", "members.date_of_birth", cast="timestamp", op="parse_date", args={"format": "%Y-%m-%d"}),
    M.Field("member_sex", "members.sex", value_map={"M": "male", "F": "female"}, on_unmapped="quarantine"),
    M.Field("member_email", "members_emails.email_address"), M.Field("member_city", "members_addresses.city"), M.Field("member_phone", "members_phones.phone_number"),
))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, dict(zip(NAMES, r, strict=True))) for i, r in enumerate(ROSTER, 1)]
    return spark.createDataFrame(data, "row_number long, raw_row map<string,string>")


def test_roster(spark, rows, tmp_path):
    found = M.promote(rows, SPEC, str(tmp_path), "b1")
    assert found["balance"] == {"records_in": 5, "records_out": 2, "quarantined": 3, "drops": 0, "balanced": True}
    assert found["entities"] == {"members": 2, "members_emails": 1, "members_addresses": 1, "members_phones": 1}
    for child in ("members_emails", "members_addresses", "members_phones"):
        assert M.published(spark, str(tmp_path), child).first().source_system_id == "K-7301"
    q = {r.row_number: (r.outcome, [x.rule for x in r.reasons]) for r in M.published(spark, str(tmp_path), "quarantine").collect()}
    assert q == {2: ("failure", ["parse_date"]), 3: ("quarantined", ["on_unmapped_value"]), 4: ("rejected", ["on_null"])}
    hashes = {r.record_hash for r in M.published(spark, str(tmp_path), "members").collect()}
    assert M.promote(rows, SPEC, str(tmp_path), "b1") == found
    assert {r.record_hash for r in M.published(spark, str(tmp_path), "members").collect()} == hashes and len(hashes) == 2


def test_nothing_is_published_unless_it_balances(rows, tmp_path, monkeypatch):
    real = M.entity_rows
    monkeypatch.setattr(M, "entity_rows", lambda e, s, t: real(e, s, t).limit(1) if t == "members" else real(e, s, t))
    with pytest.raises(RuntimeError, match="nothing is published"):
        M.promote(rows, SPEC, str(tmp_path / "x"), "b1")
    assert not (tmp_path / "x" / "commits").exists()


def test_a_failed_replay_leaves_what_was_published(spark, rows, tmp_path, monkeypatch):
    M.promote(rows, SPEC, str(tmp_path), "b1")
    before = sorted(map(str, M.published(spark, str(tmp_path), "members").collect()))
    real = M.entity_rows
    monkeypatch.setattr(M, "entity_rows", lambda e, s, t: real(e, s, t).limit(0) if t == "members_phones" else real(e, s, t))
    with pytest.raises(RuntimeError, match="nothing is published"):
        M.promote(rows, SPEC, str(tmp_path), "b1")
    assert sorted(map(str, M.published(spark, str(tmp_path), "members").collect())) == before
    assert M.published(spark, str(tmp_path), "members_phones").count() == 1


def test_entities_are_typed_and_audited(spark, rows, tmp_path):
    M.promote(rows, SPEC, str(tmp_path), "b1", canonical={"members.date_of_birth": "date"}, source_system="clinic")
    one = M.published(spark, str(tmp_path), "members").where("row_number = 1").first()
    assert one.date_of_birth == dt.date(1963, 2, 28) and one.source_system == "clinic" and one.batch_id == "b1" and one.created_ts == one.updated_ts
    assert dict(M.published(spark, str(tmp_path), "members").dtypes)["row_number"] == "bigint"
    found = {(r.outcome, r.source, r.rule): r.n_rows for r in M.summary(M.published(spark, str(tmp_path), "quarantine")).collect()}
    assert found == {("failure", "member_dob", "parse_date"): 1, ("rejected", "member_id", "on_null"): 1, ("quarantined", "member_sex", "on_unmapped_value"): 1}


def test_bronze_is_refused(spark, rows, tmp_path):
    with pytest.raises(ValueError, match="Bronze"):
        M.promote(rows, SPEC, str(tmp_path / "bronze" / "roster"), "b1")
    spark.createDataFrame([("x", 1)], "bronze_id string, row_number long").write.parquet(str(tmp_path / "landed"))
    with pytest.raises(ValueError, match="Bronze"):
        L.replace_batch(rows.withColumn("batch_id", F.lit("b1")), str(tmp_path / "landed"), "b1")


def test_append_sees_that_earlier_batches_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "landed")
    batch = lambda b: L.bronze(spark.createDataFrame([(1, "a"), (2, "b")], "row_number long, v string"), "roster", b, "sys")
    assert L.append_checked(batch("b1"), path) == 2 and L.append_checked(batch("b2"), path) == 2
    state = {r.batch_id: (r.n_rows, r.state) for r in L.batch_state(spark.read.parquet(path)).collect()}
    assert state["b1"][0] == 2 and state["b1"] != state["b2"]
    real = L.append

    def careless(rows, to):
        next((tmp_path / "landed" / "batch_id=b1").glob("*.parquet")).unlink()
        return real(rows, to)

    monkeypatch.setattr(L, "append", careless)
    with pytest.raises(RuntimeError, match="b1"):
        L.append_checked(batch("b3"), path)


def test_tallies(rows):
    some = M.evaluate(rows.where("row_number < 5"), M.Spec("members", SPEC.fields[:4]))
    assert [r.outcome for r in some.orderBy("row_number").collect()] == ["ok", "failure", "quarantined", "rejected"]
    found = {(r.tally, r["name"]): r.n for r in M.tallies(some).collect()}
    assert {k[1]: n for k, n in found.items() if k[0] == "failure"} == {"member_dob:parse_date": 1, "member_id:on_null": 1, "member_sex:on_unmapped_value": 1}


def test_policies(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": " "}), (2, {"b": "q"})], "row_number long, raw_row map<string,string>")
    spec = M.Spec("t", (M.Field("a", "t.a", value_map={"z": "1"}, on_unmapped="null"), M.Field("b", "t.b", on_null="default", default="d")))
    got = [[(f.mapped_value, f.outcome, f.rule) for f in r.fields] + [r.outcome] for r in M.evaluate(rows, spec).orderBy("row_number").collect()]
    assert got == [[(None, "null", "on_unmapped_value"), ("d", "defaulted", None), "ok"], [(None, "null", None), ("q", "ok", None), "ok"]]


@pytest.mark.parametrize("build, value, want", [
    (S.trim, "  Danielle \t", "Danielle"), (lambda c: S.concat(c, "-NY"), "FCNY", "FCNY-NY"), (lambda c: S.substring(c, 0, 4), "96863747295", "9686"),
    (lambda c: S.substring(c, 5), "96863747295", "747295"), (lambda c: S.parse_date(c, "%m/%d/%Y"), "11/04/1997", "1997-11-04"), (lambda c: S.parse_date(c, "MM/DD/YYYY"), "3/5/2026", "2026-03-05"),
    (lambda c: S.parse_date(c, "%m%d%Y"), "11041997", "1997-11-04"), (lambda c: S.parse_date(c, "%Y-%m-%d"), "13/45/1990", None), (S.cast_int, " 42 ", "42"), (S.cast_int, "abc", None), (S.cast_int, "99999999999999999999", None),
    (S.cast_decimal, "3.50", "3.50"), (S.cast_decimal, "1.2.3", None), (S.cast_decimal, "NaN", None), (S.cast_bool, "Yes", "true"), (S.cast_bool, "no", "false"), (S.cast_bool, "maybe", None),
    (S.cast_date, "1997-11-04", "1997-11-04"), (S.cast_date, "11/04/1997", "1997-11-04"), (S.cast_date, "19971104", None), (S.cast_timestamp, "1997-11-04", "1997-11-04T00:00:00+00:00"), (S.cast_date, "not-a-date", None),
])
def test_scalars(spark, build, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0] == want


def test_validation_names_everything_at_once():
    bad = M.Spec("t", (M.Field("", "t.a"), M.Field("x", "t.a", cast="blob"), M.Field("x", "t.zz", op="substring"), M.Field("y", "t.b", on_null="default"), M.Field("z", "t.c", on_unmapped="null"), M.Field("w", "t.d", op="fly", on_null="maybe")))
    found = M.errors(bad, {"t.a": "string", "t.b": "int64", "t.c": "string", "t.d": "string"})
    assert {(i, a) for i, a, _ in found} == {(0, "source"), (1, "target"), (1, "cast"), (2, "source"), (2, "target"), (2, "transform"), (3, "default"), (3, "cast"), (4, "on_unmapped"), (5, "transform"), (5, "on_null")}
    assert M.errors(SPEC, {f.target: "timestamp_utc" if f.cast == "timestamp" else "string" for f in SPEC.fields}) == [] and M.errors(M.Spec("t", ()), {})
    assert M.fingerprint(SPEC) == M.fingerprint(M.Spec(SPEC.target_table, tuple(M.Field(**{**f.__dict__, "note": "x"}) for f in SPEC.fields)))
    with pytest.raises(ValueError):
        S.substring(F.lit("x"), -1)


def test_normalisations(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(S.split_name(lit("DOE, JANE, MD"))).asDict() == {"first": "JANE, MD", "last": "DOE"}
    assert one(S.ndc11(lit("12345-678-90"))) == "12345067890" and one(S.ndc11(lit("1-2"))) is None
    assert one(S.any_date(lit("1980"))) == dt.datetime(1980, 1, 1) and one(S.any_date(lit("20240229153045123"))).microsecond == 123000
    assert float(one(S.amount(lit("($1,234.50)")))) == -1234.5 and one(S.flag(lit(" "))) is None and one(S.null_tokens(lit("n/a"))) is None
    assert one(S.code_list(lit("e11.9, ;I10"))) == ["E119", "I10"] and one(S.zip_parts(lit("12207-1234"))).zip4 == "1234"


def test_what_promotion_writes_once_is_flat(spark, rows, tmp_path, monkeypatch):
    seen, real = [], M.written

    def kept(df, label):
        out = real(df, label)
        seen.append([r.asDict() for r in out.collect()])
        return out

    monkeypatch.setattr(M, "written", kept)
    M.promote(rows, SPEC, str(tmp_path), "b1")
    (told,) = seen
    assert {r["row_number"]: (r["raw_row"] is None, r["reasons"] is None) for r in told} == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (True, True)}
    assert "fields" not in told[0] and {f"_to{i}" for i in range(len(SPEC.fields))} < set(told[0])
    held = {r.row_number: r.raw_row for r in M.published(spark, str(tmp_path), "quarantine").collect()}
    assert held == {i: dict(zip(NAMES, ROSTER[i - 1], strict=True)) for i in (2, 3, 4)}
