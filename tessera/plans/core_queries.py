"""Promotion, transforms, landing and profiles over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars as S
from tessera.operators import mapping as M
from tessera.operators import profile as P
from tessera.operators import sketches as K
from tessera.plans import scratch
from tessera.plans.scratch import written
from tessera.sources import landing as L

CANONICAL = {"claim_header.source_system_id": "string", "claim_header.claim_number": "string", "claim_header.status": "string", "claim_header.service_date": "date", "claim_adjudication.allowed": "decimal", "claim_line.priority": "string", "claim_line.channel": "string"}
SPEC = M.Spec("silver_raw.claim_header", (
    M.Field("claim_id", "claim_header.claim_number", on_null="reject"),
    M.Field("member_id", "claim_header.source_system_id", cast="string"),
    M.Field("status", "claim_header.status", value_map={"F": "final", "O": "open"}, on_unmapped="quarantine"),
    M.Field("service_date", "claim_header.service_date", op="parse_date", args={"format": "%Y-%m-%d"}, cast="date"),
    M.Field("allowed", "claim_adjudication.allowed", cast="decimal"),
    M.Field("priority", "claim_line.priority", op="substring", args={"start": 2}),
    M.Field("channel", "claim_line.channel", on_null="default", default="paper"),
))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as an all-string claims feed with gaps and bad values, as Bronze rows."""
    o = L.spread(table(spark, d, "orders"))
    k = F.col("o_orderkey")
    raw = {
        "claim_id": F.when(k % 17 == 0, "").otherwise(k.cast("string")), "member_id": F.col("o_custkey").cast("string"), "status": F.col("o_orderstatus"),
        "service_date": F.when(k % 23 == 0, "13/45/1990").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "allowed": F.when(F.col("o_totalprice") < 50000, "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        "priority": F.col("o_orderpriority"), "channel": F.when(k % 5 == 0, " ").otherwise("edi"),
    }
    pairs = [x for n, c in raw.items() for x in (F.lit(n), c)]
    return o.select(k.cast("long").alias("row_number"), F.create_map(*pairs).alias("raw_row"))


FEED = """feed AS (SELECT CAST(o_orderkey AS BIGINT) AS row_number, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS claim_id,
  CAST(o_custkey AS VARCHAR) AS member_id, o_orderstatus AS status, CASE WHEN o_orderkey % 23 = 0 THEN '13/45/1990' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS service_date,
  CASE WHEN o_totalprice < 50000 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS allowed, o_orderpriority AS priority, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'edi' END AS channel FROM orders),
judged AS (SELECT *, claim_id = '' AS rejected, service_date = '13/45/1990' AS failed, status NOT IN ('F', 'O') AS strange FROM feed),
done AS (SELECT *, CASE WHEN rejected THEN 'rejected' WHEN failed THEN 'failure' WHEN strange THEN 'quarantined' ELSE 'ok' END AS outcome FROM judged)"""


def evaluated(spark, d):
    return M.evaluate(feed(spark, d), SPEC)


def evaluated_once(spark, d):
    """Written, for queries that read it several times."""
    return written(evaluated(spark, d), "evaluated")


def promotion_balance(spark, d):
    """The batch's balance at the grain of source rows."""
    return M.balance(evaluated(spark, d), SPEC)


def promotion_outcomes(spark, d):
    return M.outcome_counts(evaluated(spark, d))


def promotion_tallies(spark, d):
    return M.tallies(evaluated(spark, d))


def promotion_quarantine(spark, d):
    q = M.quarantine(evaluated(spark, d))
    rules = F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["source"], r["rule"])), ",")
    return q.select("row_number", "outcome", rules.alias("rules"))


def promotion_entities(spark, d):
    """Rows of each entity by the fan-out, beside the independent expectation."""
    done = evaluated_once(spark, d)
    parts = [M.entity_rows(done, SPEC, t).agg(F.count("*").alias("n_rows")).withColumn("entity", F.lit(t)) for t in M.entities(SPEC)]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got.join(M.expected_rows(done, SPEC).withColumnRenamed("n", "expected"), "entity", "left").select("entity", "n_rows", "expected")


def promotion_adjudication(spark, d):
    """A child entity with the member key handed down and its own hash."""
    return M.entity_rows(evaluated(spark, d), SPEC, "claim_adjudication").select("row_number", "allowed", "source_system_id", "record_hash")


def promotion_written(spark, d):
    """A batch promoted twice through staging, read back."""
    path = f"{scratch.shared_dir(spark)}/tessera/silver-{uuid.uuid4().hex}"
    rows = feed(spark, d)
    M.promote(rows, SPEC, path, "b1")
    M.promote(rows, SPEC, path, "b1")
    out = None
    for t in (*M.entities(SPEC), "quarantine"):
        part = M.published(spark, path, t).agg(F.count("*").alias("n_rows"), F.count_distinct("row_number").alias("n_sources")).withColumn("entity", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.select("entity", "n_rows", "n_sources")


def _promoted(spark, d, spec=None, rows=None) -> str:
    """A batch promoted once; where to."""
    path = f"{scratch.shared_dir(spark)}/tessera/silver-{uuid.uuid4().hex}"
    M.promote(feed(spark, d) if rows is None else rows, spec or SPEC, path, "b1", source_system="orders")
    return path


def promotion_typed(spark, d):
    """The primary entity as its contract has it: dates are dates, audit columns are there."""
    header = M.published(spark, _promoted(spark, d), "claim_header")
    return header.select("row_number", "claim_number", "status", F.date_add("service_date", 1).cast("string").alias("next_day"), "batch_id", "source_system", (F.col("created_ts") == F.col("updated_ts")).alias("fresh"))


def quarantine_summary(spark, d):
    """What a batch's quarantine holds, by outcome and rule."""
    return M.summary(M.published(spark, _promoted(spark, d), "quarantine"))


def quarantine_page(spark, d):
    """One page of a batch's quarantine, in the order of its rows."""
    return L.page(M.published(spark, _promoted(spark, d), "quarantine"), limit=50, offset=20).select("row_number", "outcome")


WIDE_FIELDS = 45
WIDE_SPEC = M.Spec("silver_raw.entity0", tuple(M.Field(f"c{i:02}", f"entity{i % 5}.f{i:02}", cast="int" if i % 3 == 0 else "string", op="trim" if i % 4 == 0 else None, on_null="default" if i % 9 == 8 else "pass", default="none" if i % 9 == 8 else None) for i in range(WIDE_FIELDS)))


def promotion_wide(spark, d):
    """M1 to M19 over a feed of 45 columns and five entities."""
    o = L.spread(table(spark, d, "orders"))
    k = F.col("o_orderkey")
    cells = [x for i in range(WIDE_FIELDS) for x in (F.lit(f"c{i:02}"), F.when((k + i) % 50 == 0, "").otherwise((k * (i + 1)).cast("string")))]
    rows = o.select(k.cast("long").alias("row_number"), F.create_map(*cells).alias("raw_row"))
    path, out = _promoted(spark, d, WIDE_SPEC, rows), None
    for t in M.entities(WIDE_SPEC):
        first = min(M.entities(WIDE_SPEC)[t])
        part = M.published(spark, path, t).agg(F.count("*").alias("n_rows"), F.count(first).alias("filled"), F.sum(F.col(first).cast("long")).alias("total")).withColumn("entity", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


def landing_append(spark, d):
    """Batches appended to Bronze one after another, the earlier ones unchanged."""
    path = f"{scratch.shared_dir(spark)}/tessera/bronze-{uuid.uuid4().hex}"
    rows = L.numbered(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")), F.col("name"))
    written_ = {b: L.append_checked(L.bronze(rows.where(f"region {c}"), "nations", b, "sys"), path) for b, c in (("b1", "< 2"), ("b2", "= 2"), ("b3", "> 2"))}
    told = spark.createDataFrame(list(written_.items()), "batch_id string, n_written long")
    return L.batch_state(spark.read.parquet(path)).join(told, "batch_id").select("batch_id", "n_rows", "n_written")


def promotion_preview(spark, d):
    """A reproducible spread sample, evaluated and masked."""
    rows = feed(spark, d)
    some = M.masked(M.evaluate(L.strided(rows, 200, rows.count()), SPEC), {"member_id"}, {"claim_adjudication.allowed"})
    one = F.get("fields", F.lit(1))
    two = F.get("fields", F.lit(4))
    return some.select("row_number", "outcome", one["source_value"].alias("member"), two["mapped_value"].alias("allowed"), F.size("reasons").alias("n_reasons"))


def spec_catalog(spark, d):
    """A spec per status value of the feed, each against the first."""
    states = [r[0] for r in table(spark, d, "orders").select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]
    out = None
    base = M.catalog(spark, {"base": SPEC})
    for s in states:
        changed = M.Spec(SPEC.target_table, tuple(f if f.source != "status" else M.Field("status", f.target, value_map={s: "kept"}, on_unmapped="null") for f in SPEC.fields[:-1]))
        diff = M.difference(base, M.catalog(spark, {s: changed})).withColumn("state", F.lit(s)).withColumn("n_errors", F.lit(len(M.errors(changed, CANONICAL))))
        out = diff if out is None else out.unionByName(diff)
    return out.select("state", "source", "change", "attributes", "n_errors")


STRICT_TYPES = {"members.source_system_id": "string", "members.balance": "decimal", "members.rank": "int64", "members.level": "int64", "members.seen": "timestamp_utc"}
STRICT_SPEC = M.Spec("silver_raw.members", (
    M.Field("id", "members.source_system_id", on_null="reject"),
    M.Field("balance", "members.balance", cast="decimal"),
    M.Field("rank", "members.rank"),
    M.Field("level", "members.level", cast="int", on_null="default", default="none"),
    M.Field("seen", "members.seen", cast="date"),
))


def promotion_strict(spark, d):
    """Values that their contract's type cannot hold as they are, and defaults that it cannot hold at all, are failures and in quarantine; all others arrive as they were."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    balance = F.when(k % 5 == 0, "123456789012345678.5").when(k % 7 == 0, "1.23456").otherwise(F.concat(k.cast("string"), F.lit(".2500")))
    cells = {"id": k.cast("string"), "balance": balance, "rank": F.when(k % 11 == 0, "abc").otherwise((k % 90).cast("string")), "level": F.when(k % 13 == 0, "").otherwise("7"), "seen": F.lit("2024/01/05")}
    raw = c.select(k.alias("row_number"), F.create_map(*[x for n, v in cells.items() for x in (F.lit(n), v)]).alias("raw_row"), F.sha2(k.cast("string"), 256).alias("record_hash"))
    path = f"{scratch.shared_dir(spark)}/tessera/strict-{uuid.uuid4().hex}"
    M.promote(raw, STRICT_SPEC, path, "b1", STRICT_TYPES)
    kept = M.published(spark, path, "members").select(F.col("source_system_id").alias("id"), F.lit("").alias("why"), F.col("balance").cast("string").alias("balance"), "rank", "level")
    held = M.published(spark, path, "quarantine").select(F.col("raw_row")["id"].alias("id"), F.array_join(F.array_sort(F.transform("reasons", lambda r: F.concat_ws(":", r["source"], r["outcome"], r["rule"]))), ",").alias("why"))
    return kept.unionByName(held, allowMissingColumns=True)


#: Specs that are wrong in one way each, by attribute, with what is wrong.
WRONG = {
    "cast int64": (M.Field("a", "t.n", cast="string"), "cast"), "cast date": (M.Field("a", "t.d", cast="timestamp"), "cast"), "cast text": (M.Field("a", "t.s", cast="int"), "cast"), "no cast": (M.Field("a", "t.s", cast="money"), "cast"),
    "target": (M.Field("a", "t.x"), "target"), "no source": (M.Field(" ", "t.s"), "source"), "op": (M.Field("a", "t.s", op="shout"), "transform"), "argument": (M.Field("a", "t.s", op="substring"), "transform"),
    "default": (M.Field("a", "t.n", cast="int", on_null="default", default="none"), "default"), "lone default": (M.Field("a", "t.s", default="x"), "default"), "policy": (M.Field("a", "t.s", on_null="guess"), "on_null"), "no map": (M.Field("a", "t.s", on_unmapped="null"), "on_unmapped"),
}
FINE = [M.Field("a", "t.n", cast="int"), M.Field("a", "t.m", cast="int"), M.Field("a", "t.m", cast="decimal"), M.Field("a", "t.w", cast="date"), M.Field("a", "t.w", cast="timestamp"), M.Field("a", "t.u", cast="string"), M.Field("a", "t.n", cast="int", on_null="default", default=" 7 ")]


def spec_errors(spark, d):
    """What is wrong with specs, a field of each kind for every region; sound ones have no row."""
    types = {"t.s": "string", "t.n": "int64", "t.m": "decimal", "t.d": "date", "t.w": "timestamp_utc", "t.u": "uuid"}
    found = []
    for (r,) in table(spark, d, "region").select("r_name").collect():
        for label, f in [*((k, v[0]) for k, v in WRONG.items()), *(("fine", f) for f in FINE)]:
            found += [(r, label, attribute) for _, attribute, _ in M.errors(M.Spec("silver_raw.t", (f,)), types)]
    return spark.createDataFrame(found, "region string, spec string, attribute string")


def transforms(spark, d):
    """P1 to P10 over customers."""
    c = table(spark, d, "customer")
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    padded = F.concat(F.lit("\t "), name, F.lit("  "))
    us = F.concat(F.lit("3/"), (F.col("c_custkey") % 28 + 1).cast("string"), F.lit("/2026"))
    return c.select(
        "c_custkey", S.trim(padded).alias("trimmed"), F.upper("c_name").alias("uppered"), F.lower("c_mktsegment").alias("lowered"), S.concat(name, "-NY").alias("joined"),
        S.substring(name, 9).alias("digits"), S.substring(name, 0, 4).alias("head"), S.parse_date(us, "%m/%d/%Y").alias("parsed"), S.cast_int(F.concat(F.lit(" "), key)).alias("whole"),
        S.cast_int(F.concat(key, F.lit(".5"))).alias("not_whole"), S.cast_bool(F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("maybe")).alias("truth"),
        S.cast_date(F.concat(F.lit("2024/1/"), (F.col("c_custkey") % 28 + 1).cast("string"))).alias("day"), S.cast_timestamp(F.lit("1997-11-04")).alias("moment"), S.cast_date(F.lit("19971104")).alias("never"),
    )


TRANSFORMS_SQL = """SELECT c_custkey, c_name AS trimmed, upper(c_name) AS uppered, lower(c_mktsegment) AS lowered, c_name || '-NY' AS joined, substr(c_name, 10) AS digits, substr(c_name, 1, 4) AS head,
 strftime(make_date(2026, 3, CAST(c_custkey % 28 + 1 AS INT)), '%Y-%m-%d') AS parsed, CAST(c_custkey AS VARCHAR) AS whole, CAST(NULL AS VARCHAR) AS not_whole, CASE WHEN c_custkey % 2 = 0 THEN 'true' END AS truth,
 strftime(make_date(2024, 1, CAST(c_custkey % 28 + 1 AS INT)), '%Y-%m-%d') AS day, '1997-11-04T00:00:00+00:00' AS moment, CAST(NULL AS VARCHAR) AS never FROM customer"""


def normalisations(spark, d):
    """N1 to N14 over values derived from customers."""
    k = F.col("c_custkey")
    digits = F.lpad(k.cast("string"), 9, "0")
    c = table(spark, d, "customer").select(k.alias("k"), "c_name", digits.alias("d"), "c_acctbal", "c_mktsegment")
    d_, m = F.col("d"), F.col("k") % 4
    money = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number("c_acctbal", 2)))
    shape = F.when(m == 0, F.lit("1EG4TE5MK73")).when(m == 1, F.concat(F.lit("AB"), F.right(d_, F.lit(5)), F.lit("C"))).when(m == 2, F.concat(F.left(d_, F.lit(2)), F.lit("-"), F.right(d_, F.lit(7)))).otherwise(F.concat(F.lit("X"), F.right(d_, F.lit(3))))
    stamp = F.when(m == 0, F.lit("20240229")).when(m == 1, F.lit("202402291530")).when(m == 2, F.lit("20240229153045")).otherwise(F.lit("20240229153045123"))
    return c.select(
        "k", S.null_tokens(F.when(m == 0, F.lit(" n/a ")).otherwise(F.col("c_name"))).alias("named"), S.unquoted(F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))).alias("bare"),
        S.split_name(F.concat_ws(", ", "c_mktsegment", "c_name"))["first"].alias("first"), S.split_name(F.concat_ws(" ", "c_name", "c_mktsegment"))["last"].alias("last"), S.flag(F.when(m == 0, "Y").when(m == 1, "n").otherwise(" ")).alias("flag"),
        F.date_format(S.any_date(stamp), "yyyy-MM-dd HH:mm:ss.SSS").alias("moment"), S.without_sentinel(F.when(m == 0, F.to_date(F.lit("1900-01-01"))).otherwise(F.to_date(F.lit("2020-05-05"))), F.to_date(F.lit("2024-01-01"))).cast("string").alias("real_day"),
        S.icd(F.concat(F.lit(" e11."), F.right(d_, F.lit(2)))).alias("icd"), S.ndc11(F.concat_ws("-", F.left(d_, F.lit(4)), F.substring(d_, 5, 4), F.right(d_, F.lit(2)))).alias("ndc"),
        S.npi_valid(F.concat(F.lit("123456789"), (F.col("k") % 10).cast("string"))).alias("npi_ok"), S.first_npi(F.lit("Mercy Hospital (1234567893)")).alias("npi"),
        S.zip_parts(F.concat(F.right(d_, F.lit(5)), F.lit("-0123")))["zip5"].alias("zip5"), F.size(S.code_list(F.concat(d_, F.lit(", a1; |b2")))).alias("n_codes"),
        S.bill_type(F.lit("1"), F.lit("3"), (F.col("k") % 8).cast("string")).alias("bill"), F.size(S.tin_list(F.concat(F.lit("12-3456789,"), d_))).alias("n_tins"),
        S.amount(money).cast("double").alias("amount"), S.identifier_shape(shape).alias("shape"),
    )


NORMALISATIONS_SQL = """WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d, c_custkey % 4 AS m FROM customer)
SELECT k, CASE WHEN m = 0 THEN NULL ELSE c_name END AS named, c_name AS bare, c_name AS first, c_mktsegment AS last, CASE m WHEN 0 THEN true WHEN 1 THEN false END AS flag,
 CASE m WHEN 0 THEN '2024-02-29 00:00:00.000' WHEN 1 THEN '2024-02-29 15:30:00.000' WHEN 2 THEN '2024-02-29 15:30:45.000' ELSE '2024-02-29 15:30:45.123' END AS moment,
 CASE WHEN m = 0 THEN NULL ELSE '2020-05-05' END AS real_day, 'E11' || right(d, 2) AS icd, '0' || left(d, 4) || substr(d, 5, 4) || right(d, 2) AS ndc, k % 10 = 3 AS npi_ok, '1234567893' AS npi,
 right(d, 5) AS zip5, CAST(3 AS INT) AS n_codes, '13' || CAST(k % 8 AS VARCHAR) AS bill, CAST(2 AS INT) AS n_tins, c_acctbal AS amount,
 CASE m WHEN 0 THEN 'MBI' WHEN 1 THEN 'CIN' WHEN 2 THEN 'TIN' ELSE 'A999' END AS shape FROM c"""


def regions(spark, d):
    """Lookups of nations and regions, and an effective-dated reference by range."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    ref = n.select(F.col("n_nationkey"), F.explode(F.array(F.struct(F.lit(0.0).alias("a"), F.lit(5000.0).alias("b"), F.lit("basic").alias("tier")), F.struct(F.lit(5000.0).alias("a"), F.lit(1e9).alias("b"), F.lit("plus").alias("tier")))).alias("t")).select("n_nationkey", "t.*")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).drop("n_nationkey").join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    j = j.join(F.broadcast(ref), (F.col("c_nationkey") == ref.n_nationkey) & (F.col("c_acctbal") >= ref.a) & (F.col("c_acctbal") < ref.b), "left")
    return j.groupBy("r_name", F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"))


def repeated_blocks(spark, d):
    """Two address blocks of a row become rows of a constant type."""
    c = table(spark, d, "customer")
    blocks = F.array(*[F.struct(F.lit(t).alias("address_type"), v.alias("line")) for t, v in (("mailing", F.concat(F.col("c_name"), F.lit(" box"))), ("physical", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))))])
    return c.select("c_custkey", F.inline(blocks)).where("line is not null")


def landing_numbers(spark, d):
    """Numbers without a gap in key order, and content hashes."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("claim"), F.col("o_custkey").cast("string").alias("member"), "o_orderstatus")
    rows = L.numbered(o, F.col("claim").cast("long"))
    return rows.select("row_number", "claim", L.record_hash(["claim", "member", "o_orderstatus"]).alias("record_hash"))


def landing_csv(spark, d):
    """Customers written as a folder of piped files, landed again, appended as Bronze, and paged."""
    base = f"{scratch.shared_dir(spark)}/tessera/landing-{uuid.uuid4().hex}"
    c = table(spark, d, "customer")
    c.select(F.concat(F.lit(" "), F.col("c_name")).alias(" name "), F.col("c_custkey").alias("id"), F.lit("").alias("blank"), F.col("c_mktsegment").alias("name")).write.csv(f"{base}/in", sep="|", header=True)
    rows = L.numbered(L.read_delimited(spark, f"{base}/in"))
    n = L.append(L.bronze(rows, "roster", "b1", "sys"), f"{base}/bronze")
    back = spark.read.parquet(f"{base}/bronze").where("batch_id = 'b1'")
    return back.select(F.col("raw_row")["id"].cast("long").alias("id"), F.col("raw_row")["name"].alias("name"), F.col("raw_row")["name_1"].alias("segment"), F.col("raw_row")["blank"].alias("blank"), (F.lit(n) == F.lit(c.count())).alias("all_written"))


def landed_text(spark, rows: DataFrame, header: str) -> str:
    """Folders of text files, one for each ``file`` of ``rows`` (file, line), each beginning with ``header``; the folder they are in."""
    path = f"{scratch.shared_dir(spark)}/tessera/text-{uuid.uuid4().hex}"
    heads = rows.select("file").distinct().select("file", F.lit(header).alias("line"), F.lit(0).alias("nth"))
    every = heads.unionByName(rows.withColumn("nth", F.lit(1)))
    every.repartition("file").sortWithinPartitions("file", "nth", "line").select("file", "line").write.partitionBy("file").text(path)
    return path


def landing_mixed(spark, d):
    """One delivery of UTF-8 and Latin-1 files, with commas, pipes and semicolons, and with line breaks in quoted cells; numbered within each kind."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    base = f"{scratch.shared_dir(spark)}/tessera/landing-{uuid.uuid4().hex}"
    kinds = {
        "a": ({"sep": ","}, F.concat(F.lit("José "), F.col("c_name"))), "b": ({"sep": ",", "encoding": "ISO-8859-1"}, F.concat(F.lit("Zoë "), F.col("c_name"))),
        "c": ({"sep": "|"}, F.concat(F.lit("a,b "), F.col("c_name"))), "d": ({"sep": ";", "quoteAll": True}, F.concat(F.col("c_name"), F.lit("\n\nsays \"no\";"), F.col("c_mktsegment"))),
    }
    for i, (kind, (options, name)) in enumerate(kinds.items()):
        c.where(k % 4 == i).select(k.cast("string").alias("id"), name.alias("name"), F.col("c_mktsegment").alias("segment")).write.csv(f"{base}/in/{kind}", header=True, escape='"', **options)
    rows = L.read_delimited(spark, f"{base}/in/*", placed=True)
    numbered = L.in_file_order(rows.withColumn("kind", F.regexp_extract("_file", "/in/([a-d])/", 1)))
    first = Window.partitionBy("kind").orderBy("row_number")
    return numbered.select(F.col("id").cast("long").alias("id"), "name", "segment", "kind", F.row_number().over(first).cast("long").alias("place"))


def landing_paths(spark, d):
    """Path parts, business dates from names, and content already landed left out."""
    e = table(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyyMMdd").alias("day"))
    path = F.concat_ws("/", F.lit("adt"), F.concat(F.lit("sys"), F.col("user_id") % 3), F.lit("events"), F.lit("inbound"), F.col("day"), F.concat(F.lit("ADT_"), F.col("day"), F.lit(".csv")))
    files = e.select(path.alias("path")).distinct().select("path", L.landing_parts(F.col("path")).alias("p"), F.sha2("path", 256).alias("fingerprint"))
    known = files.where("p.source_system = 'sys0'").select("fingerprint")
    new = files.join(known, "fingerprint", "left_anti")
    return new.select("p.source_system", "p.business_date", "p.file", L.file_tokens(F.col("p.file"), r"_(\d{8})\.", "yyyyMMdd").cast("string").alias("token"))


def landing_files(spark, d):
    """Of a folder of files, those whose content the manifest does not have, whatever they are called."""
    base = f"{scratch.shared_dir(spark)}/tessera/files-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select("c_mktsegment", F.concat_ws("|", "c_custkey", "c_name").alias("line"))
    c.repartition("c_mktsegment").sortWithinPartitions("line").write.partitionBy("c_mktsegment").text(f"{base}/first")
    segment = F.regexp_extract("path", "c_mktsegment=([^/]+)", 1).alias("segment")
    none = spark.createDataFrame([], "fingerprint string")
    known = L.new_files(spark, f"{base}/first/*/*.txt", none).select(segment, "fingerprint").where("segment < 'C'")
    return L.new_files(spark, f"{base}/first/*/*.txt", written(known, "manifest")).select(segment).distinct()


def ndjson(spark, d):
    """JSON properties of events as lines of a landed file, read with a schema; what does not parse is kept apart."""
    path = f"{scratch.shared_dir(spark)}/tessera/lines-{uuid.uuid4().hex}"
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    table(spark, d, "events").select(text.alias("value")).write.text(path)
    got = written(L.read_ndjson(spark, path, T.StructType([T.StructField("k", T.IntegerType())])), "ndjson")
    return got.groupBy(F.col("_corrupt_record").isNotNull().alias("corrupt")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def _wide(spark, d) -> DataFrame:
    """Orders as a wide all-string table with gaps and placeholders."""
    o, k = L.spread(table(spark, d, "orders")), F.col("o_orderkey")
    return o.select(
        k.cast("long").alias("row_number"), k.cast("string").alias("claim_id"), F.col("o_custkey").cast("string").alias("member_id"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 10 == 0, "9999-12-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("service_date"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("allowed"),
        F.col("o_orderpriority").alias("priority"), F.lit("").alias("spare"), F.lit("EDI").alias("channel"), F.date_format("o_orderdate", "yyyyMM").alias("claim_month"), F.when(k % 2 == 0, "Y").otherwise("N").alias("urgent_flag"),
    )


WIDE = """wide AS (SELECT CAST(o_orderkey AS BIGINT) AS row_number, CAST(o_orderkey AS VARCHAR) AS claim_id, CAST(o_custkey AS VARCHAR) AS member_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 10 = 0 THEN '9999-12-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS service_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS allowed, o_orderpriority AS priority, '' AS spare, 'EDI' AS channel,
 strftime(o_orderdate, '%Y%m') AS claim_month, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS urgent_flag FROM orders),
cells AS (UNPIVOT wide ON claim_id, member_id, status, service_date, allowed, priority, spare, channel, claim_month, urgent_flag INTO NAME "column" VALUE v),
facts AS (SELECT "column", count(*) AS row_count, count(*) FILTER (v = '') AS null_count, count(DISTINCT v) FILTER (v <> '') AS distinct_count, count(*) FILTER (v <> '') AS filled, count(*) FILTER (regexp_full_match(v, '[+-]?\\d+')) AS ints, count(*) FILTER (regexp_full_match(v, '[+-]?\\d*\\.\\d+')) AS decimals,
 count(*) FILTER (regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}|\\d{1,2}/\\d{1,2}/\\d{4}|\\d{1,2}-\\d{1,2}-\\d{4}|\\d{8}')) AS dates, count(*) FILTER (regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}[ T]\\d{1,2}:\\d{2}')) AS stamps,
 count(*) FILTER (lower(v) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '0', '1')) AS bools, count(*) FILTER (regexp_full_match(v, '[A-Z0-9][A-Z0-9._-]{0,15}')) AS codes FROM cells GROUP BY 1)"""
#: Types and roles as the rules say, from what the columns hold and are called.
TYPES_SQL = """CASE WHEN filled = 0 THEN 'string' WHEN stamps / filled >= 0.95 THEN 'timestamp' WHEN dates / filled >= 0.95 THEN 'date' WHEN bools / filled >= 0.95 AND ints / filled < 0.95 THEN 'bool'
 WHEN decimals / filled >= 0.5 AND (ints + decimals) / filled >= 0.95 THEN 'decimal' WHEN ints / filled >= 0.95 THEN 'int' WHEN codes / filled >= 0.95 THEN 'code' ELSE 'string' END"""
WORDS_SQL = "list_has_any(string_split(\"column\", '_'), [{}])"
ROLES_SQL = f"""CASE WHEN {WORDS_SQL.format("'created', 'updated', 'modified', 'batch', 'etl', 'loaded'")} THEN 'technical' WHEN distinct_count = 0 THEN 'unclassified' WHEN inferred_type IN ('date', 'timestamp') OR (inferred_type = 'int' AND {WORDS_SQL.format("'month', 'year', 'period', 'quarter'")}) THEN 'date'
 WHEN {WORDS_SQL.format("'id', 'key', 'npi', 'tin'")} OR ((row_count = distinct_count) AND NOT {WORDS_SQL.format("'flag', 'status', 'type', 'code', 'number'")}) THEN 'identifier' WHEN inferred_type IN ('int', 'decimal') AND NOT {WORDS_SQL.format("'flag', 'status', 'type', 'code', 'number'")} THEN 'measure'
 WHEN inferred_type <> 'decimal' AND (distinct_count <= 50 OR distinct_count / row_count < 0.05) THEN 'dimension' ELSE 'unclassified' END"""


def _facts(spark, d) -> DataFrame:
    rows = _wide(spark, d)
    facts = written(P.column_facts(rows), "facts")  # one row a column, read again for keys and roles
    return P.with_roles(facts, P.candidate_keys(rows, facts))


def profile_columns(spark, d):
    """F1 to F6, F9, F12, F13, F21."""
    return _facts(spark, d).select("column", "row_count", "null_count", "null_ratio", "distinct_count", "constant", "inferred_type", "sentinel_count", "phi_candidate", "min_value", "max_value", "role", "importance")


PROFILE_SQL = f"""WITH {WIDE} SELECT "column", row_count, null_count, round(null_count / row_count, 4) AS null_ratio, distinct_count, distinct_count = 1 AS constant, {TYPES_SQL} AS inferred_type,
 CAST((SELECT count(*) FROM cells c WHERE c."column" = f."column" AND (v = '9999-12-31' OR regexp_full_match(v, '0{{4,}}|9{{4,}}'))) AS BIGINT) AS sentinel_count, "column" = 'member_id' AS phi_candidate,
 CASE "column" WHEN 'claim_id' THEN (SELECT min_by(v, CAST(v AS DOUBLE)) FROM cells c WHERE c."column" = 'claim_id' AND NOT regexp_full_match(v, '0{{4,}}|9{{4,}}')) WHEN 'allowed' THEN (SELECT min_by(v, CAST(v AS DOUBLE)) FROM cells c WHERE c."column" = 'allowed')
  WHEN 'service_date' THEN (SELECT min(v) FROM cells c WHERE c."column" = 'service_date' AND v <> '9999-12-31') WHEN 'claim_month' THEN (SELECT min(v) FROM cells c WHERE c."column" = 'claim_month') END AS min_value,
 CASE "column" WHEN 'claim_id' THEN (SELECT max_by(v, CAST(v AS DOUBLE)) FROM cells c WHERE c."column" = 'claim_id' AND NOT regexp_full_match(v, '0{{4,}}|9{{4,}}')) WHEN 'allowed' THEN (SELECT max_by(v, CAST(v AS DOUBLE)) FROM cells c WHERE c."column" = 'allowed')
  WHEN 'service_date' THEN (SELECT max(v) FROM cells c WHERE c."column" = 'service_date' AND v <> '9999-12-31') WHEN 'claim_month' THEN (SELECT max(v) FROM cells c WHERE c."column" = 'claim_month') END AS max_value,
 {ROLES_SQL} AS role, CASE WHEN {ROLES_SQL} IN ('technical', 'unclassified') THEN 'low' WHEN row_count = distinct_count THEN 'high' ELSE 'medium' END AS importance FROM facts f"""


def profile_merged(spark, d):
    """F1 to F7 by batches: each is read once, for its state; the feed's profile is made of states, one of which was replaced."""
    rows, path = _wide(spark, d), f"{scratch.shared_dir(spark)}/tessera/states-{uuid.uuid4().hex}"
    parts = {f"b{i}": rows.where(F.pmod("row_number", F.lit(3)) == i) for i in range(3)}
    for batch, some in [("b1", rows.limit(0).union(parts["b2"])), *parts.items()]:
        K.recorded(some, path, batch)
    states = spark.read.parquet(path)
    facts = K.told(K.merged(states))
    exact = P.unpivoted(rows).where("value <> ''").groupBy("column").agg(F.count_distinct("value").alias("exact"))
    close = F.abs(F.col("distinct_count") - F.coalesce("exact", F.lit(0))) <= F.col("error") * F.coalesce("exact", F.lit(0))
    out = facts.join(exact, "column", "left").crossJoin(F.broadcast(states.agg(F.count_distinct("batch_id").alias("batches"))))
    return out.select("column", "row_count", "null_count", "inferred_type", "sentinel_count", "min_value", "max_value", close.alias("distinct_close"), F.when(F.col("column").isin("channel", "urgent_flag"), F.array_max(F.transform("top", lambda x: x["n"]))).alias("top_n"), "batches")


def profile_top(spark, d):
    """F7."""
    return P.top_values(_wide(spark, d))


def profile_samples(spark, d):
    """F8."""
    return P.sample_values(_wide(spark, d)).select("column", F.array_join("values", "|").alias("sample"))


def profile_keys(spark, d):
    """pair keys where no single column is one, and duplicate rows."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").withColumn("row_number", F.monotonically_increasing_id())
    text = l.select("row_number", *[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_returnflag")])
    keys = P.candidate_keys(text, written(P.column_facts(text), "facts"))
    return P.duplicate_rows(text).withColumn("n_keys", F.lit(len(keys)).cast("long"))


KEY_COLUMNS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_partkey", "l_suppkey", "l_tax"]


def profile_minimal(spark, d):
    """every minimal key of up to three of eight columns of the line items."""
    l = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("row_number"), *[F.col(c).cast("string").alias(c) for c in KEY_COLUMNS])
    l = written(l, "keys")
    keys = P.minimal_keys(l, written(P.column_facts(l), "facts"), 3)
    return spark.createDataFrame([(",".join(k), len(k)) for k in keys], "key string, n_columns int")


def _minimal_sql() -> str:
    from itertools import combinations

    one = [f"SELECT {list(c)} AS k FROM lineitem HAVING count(DISTINCT ({', '.join(c)})) = count(*)" for n in (1, 2, 3) for c in combinations(KEY_COLUMNS, n)]
    return f"WITH u AS ({' UNION ALL '.join(one)}) SELECT array_to_string(k, ',') AS key, CAST(len(k) AS INT) AS n_columns FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE len(v.k) < len(u.k) AND list_has_all(u.k, v.k))"


def profile_files(spark, d):
    """coverage, columns by role, and whether the content address holds on a second run."""
    facts = _facts(spark, d)
    same = F.lit(P.profile_id(facts).first()[0] == P.profile_id(_facts(spark, d)).first()[0])
    roles = P.by_role(facts).select(F.concat(F.lit("role "), F.col("role")).alias("fact"), F.array_join("columns", ",").alias("value"))
    cover = P.time_coverage(facts).select(F.lit("coverage").alias("fact"), F.concat_ws(" ", "from_date", "to_date").alias("value"))
    return roles.union(cover).withColumn("stable", same)


def profile_drift(spark, d):
    """The first 5,000 rows against all rows under other names and types."""
    rows = _wide(spark, d)
    now = P.column_facts(rows.withColumn("claim_id", F.concat(F.lit("C"), F.col("claim_id"))).drop("spare").withColumn("extra", F.lit("x")))
    then = P.column_facts(rows.orderBy("row_number").limit(5000))
    a = P.drift(now, then).withColumn("kind", F.lit("drift"))
    return a.unionByName(P.contract_drift(now, then.select("column")).withColumn("kind", F.lit("contract")))


def profile_batch(spark, d):
    """F16: the first 5,000 rows of a Bronze batch, columns as the file had them, a drifted one last."""
    order = ["status", "claim_id", "service_date", "member_id", "allowed", "priority", "gone"]
    out = P.batch_profile(feed(spark, d), order)
    return out.select("position", "column", "row_count", "null_count", "distinct_count", "rows_in_batch", "rows_profiled", "is_sample")


def dq_schema(spark, d):
    """Q11, B-02, B-03: a delivery with a new column, one gone and one emptied, against the one before."""
    rows = _wide(spark, d)
    now = rows.withColumn("status", F.lit("")).withColumn("extra", F.col("priority")).drop("urgent_flag")
    return P.schema_verdicts(P.column_facts(now), P.column_facts(rows))


def profile_anomalies(spark, d):
    """F19."""
    return P.anomalies(_facts(spark, d), null_rate=0.3)


def profile_class(spark, d):
    """which registered feed a delivery is; feeds are the tables' own columns."""
    feeds = None
    for t in ("orders", "customer", "lineitem"):
        part = spark.createDataFrame([("care", t, c) for c in table(spark, d, t).columns], "domain string, dataset string, column string")
        feeds = part if feeds is None else feeds.union(part)
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("row_number"), *[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_mktsegment")])
    facts = P.column_facts(rows)
    return P.classify_feed(facts, feeds, P.candidate_keys(rows, facts))


OUTCOMES_SQL = f"WITH {FEED} SELECT outcome, count(*) AS n_rows FROM done GROUP BY 1"
QUERIES = {
    "promotion_balance": (promotion_balance, f"WITH {FEED} SELECT count(*) AS records_in, count(*) FILTER (outcome = 'ok') AS records_out, count(*) FILTER (outcome <> 'ok') AS quarantined, CAST(0 AS BIGINT) AS drops, true AS balanced FROM done"),
    "promotion_typed": (promotion_typed, f"WITH {FEED} SELECT row_number, claim_id AS claim_number, CASE status WHEN 'F' THEN 'final' ELSE 'open' END AS status, CAST(CAST(service_date AS DATE) + 1 AS VARCHAR) AS next_day, 'b1' AS batch_id, 'orders' AS source_system, true AS fresh FROM done WHERE outcome = 'ok'"),
    "quarantine_summary": (quarantine_summary, f"""WITH {FEED}, r AS (SELECT outcome, 'claim_id' AS source, 'on_null' AS rule FROM done WHERE rejected UNION ALL SELECT outcome, 'service_date', 'parse_date' FROM done WHERE failed UNION ALL SELECT outcome, 'status', 'on_unmapped_value' FROM done WHERE strange)
 SELECT 'b1' AS batch_id, outcome, source, rule, count(*) AS n_rows FROM r GROUP BY ALL"""),
    "quarantine_page": (quarantine_page, f"WITH {FEED} SELECT row_number, outcome FROM done WHERE outcome <> 'ok' ORDER BY row_number LIMIT 50 OFFSET 20"),
    "promotion_wide": (promotion_wide, "SELECT 'entity' || e AS entity, count(*) AS n_rows, count(*) FILTER ((o_orderkey + e) % 50 <> 0) AS filled, CAST(sum(o_orderkey * (e + 1)) FILTER ((o_orderkey + e) % 50 <> 0) AS BIGINT) AS total FROM orders, range(5) t(e) GROUP BY e"),
    "landing_append": (landing_append, "SELECT CASE WHEN n_regionkey < 2 THEN 'b1' WHEN n_regionkey = 2 THEN 'b2' ELSE 'b3' END AS batch_id, count(*) AS n_rows, count(*) AS n_written FROM nation GROUP BY 1"),
    "promotion_outcomes": (promotion_outcomes, OUTCOMES_SQL),
    "promotion_tallies": (promotion_tallies, f"""WITH {FEED}, t AS (SELECT 'failure' AS tally, 'claim_id:on_null' AS name, count(*) FILTER (rejected) AS n FROM done UNION ALL SELECT 'failure', 'service_date:parse_date', count(*) FILTER (failed) FROM done
 UNION ALL SELECT 'failure', 'status:on_unmapped_value', count(*) FILTER (strange) FROM done UNION ALL SELECT 'affected', 'claim_id', count(*) FILTER (rejected) FROM done UNION ALL SELECT 'affected', 'service_date', count(*) FILTER (failed) FROM done
 UNION ALL SELECT 'affected', 'status', count(*) FILTER (strange) FROM done UNION ALL SELECT 'null_or_invalid', 'claim_header.claim_number', count(*) FILTER (rejected) FROM done UNION ALL SELECT 'null_or_invalid', 'claim_header.service_date', count(*) FILTER (failed) FROM done
 UNION ALL SELECT 'null_or_invalid', 'claim_header.status', count(*) FILTER (strange) FROM done UNION ALL SELECT 'null_or_invalid', 'claim_adjudication.allowed', count(*) FILTER (allowed = '') FROM done) SELECT * FROM t WHERE n > 0"""),
    "promotion_quarantine": (promotion_quarantine, f"WITH {FEED} SELECT row_number, outcome, concat_ws(',', CASE WHEN rejected THEN 'claim_id:on_null' END, CASE WHEN strange THEN 'status:on_unmapped_value' END, CASE WHEN failed THEN 'service_date:parse_date' END) AS rules FROM done WHERE outcome <> 'ok'"),
    "promotion_entities": (promotion_entities, f"WITH {FEED} SELECT 'claim_header' AS entity, count(*) AS n_rows, count(*) AS expected FROM done WHERE outcome = 'ok' UNION ALL SELECT 'claim_adjudication', count(*), count(*) FROM done WHERE outcome = 'ok' AND allowed <> '' UNION ALL SELECT 'claim_line', count(*), count(*) FROM done WHERE outcome = 'ok'"),
    "promotion_adjudication": (promotion_adjudication, f"WITH {FEED} SELECT row_number, allowed, member_id AS source_system_id, left(sha256('allowed=' || allowed || chr(31) || 'source_system_id=' || member_id), 32) AS record_hash FROM done WHERE outcome = 'ok' AND allowed <> ''"),
    "promotion_written": (promotion_written, f"WITH {FEED} SELECT 'claim_header' AS entity, count(*) AS n_rows, count(*) AS n_sources FROM done WHERE outcome = 'ok' UNION ALL SELECT 'claim_adjudication', count(*), count(*) FROM done WHERE outcome = 'ok' AND allowed <> '' UNION ALL SELECT 'claim_line', count(*), count(*) FROM done WHERE outcome = 'ok' UNION ALL SELECT 'quarantine', count(*), count(*) FROM done WHERE outcome <> 'ok'"),
    "promotion_preview": (promotion_preview, f"""WITH {FEED}, k AS (SELECT CASE WHEN count(*) > 200 THEN count(*) // 200 ELSE 1 END AS k FROM orders), s AS (SELECT done.* FROM done, k WHERE (row_number - 1) % k.k = 0 AND row_number > 0 ORDER BY row_number LIMIT 200)
 SELECT row_number, outcome, '•••' AS member, CASE WHEN allowed <> '' THEN '•••' END AS allowed, CAST(CAST(rejected AS INT) + CAST(failed AS INT) + CAST(strange AS INT) AS INT) AS n_reasons FROM s"""),
    "spec_catalog": (spec_catalog, "WITH s AS (SELECT DISTINCT o_orderstatus AS state FROM orders) SELECT state, 'status' AS source, 'changed' AS change, 'value_map,on_unmapped' AS attributes, CAST(0 AS INT) AS n_errors FROM s UNION ALL SELECT state, 'channel', 'removed', '', CAST(0 AS INT) FROM s"),
    "spec_errors": (spec_errors, "SELECT r_name AS region, spec, attribute FROM region, (VALUES " + ", ".join(f"('{k}', '{a}')" for k, (_, a) in WRONG.items()) + ") AS v(spec, attribute)"),
    "promotion_strict": (promotion_strict, """WITH c AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AS big, c_custkey % 7 = 0 AS fine, c_custkey % 11 = 0 AS text, c_custkey % 13 = 0 AS none FROM customer)
 SELECT CAST(k AS VARCHAR) AS id, concat_ws(',', CASE WHEN big OR fine THEN 'balance:failure:type' END, CASE WHEN none THEN 'level:failure:type' END, CASE WHEN text THEN 'rank:failure:type' END) AS why,
  CASE WHEN NOT (big OR fine OR text OR none) THEN k || '.2500' END AS balance, CASE WHEN NOT (big OR fine OR text OR none) THEN k % 90 END AS rank, CASE WHEN NOT (big OR fine OR text OR none) THEN CAST(7 AS BIGINT) END AS level FROM c"""),
    "transforms": (transforms, TRANSFORMS_SQL),
    "normalisations": (normalisations, NORMALISATIONS_SQL),
    "regions": (regions, "SELECT r_name, CASE WHEN c_acctbal < 0 THEN 'none' WHEN c_acctbal < 5000 THEN 'basic' ELSE 'plus' END AS tier, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "repeated_blocks": (repeated_blocks, "SELECT c_custkey, 'mailing' AS address_type, c_name || ' box' AS line FROM customer UNION ALL SELECT c_custkey, 'physical', c_mktsegment FROM customer WHERE c_custkey % 3 > 0"),
    "landing_files": (landing_files, "SELECT DISTINCT c_mktsegment AS segment FROM customer WHERE c_mktsegment >= 'C'"),
    "landing_numbers": (landing_numbers, "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, CAST(o_orderkey AS VARCHAR) AS claim, left(sha256('claim=' || o_orderkey || chr(31) || 'member=' || o_custkey || chr(31) || 'o_orderstatus=' || o_orderstatus), 32) AS record_hash FROM orders"),
    "landing_csv": (landing_csv, "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, '' AS blank, true AS all_written FROM customer"),
    "landing_mixed": (landing_mixed, """WITH c AS (SELECT c_custkey AS id, c_name AS n, c_mktsegment AS segment, ['a', 'b', 'c', 'd'][c_custkey % 4 + 1] AS kind FROM customer)
 SELECT id, CASE kind WHEN 'a' THEN 'José ' || n WHEN 'b' THEN 'Zoë ' || n WHEN 'c' THEN 'a,b ' || n ELSE n || chr(10) || chr(10) || 'says "no";' || segment END AS name, segment, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS place FROM c"""),
    "landing_paths": (landing_paths, "SELECT DISTINCT 'sys' || (user_id % 3) AS source_system, strftime(ts, '%Y%m%d') AS business_date, 'ADT_' || strftime(ts, '%Y%m%d') || '.csv' AS file, strftime(ts, '%Y-%m-%d') AS token FROM events WHERE user_id % 3 <> 0"),
    "ndjson": (ndjson, "SELECT event_id % 10 = 0 AS corrupt, count(*) AS n, CAST(sum(CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS total FROM events GROUP BY 1"),
    "profile_columns": (profile_columns, PROFILE_SQL),
    "profile_merged": (profile_merged, f"""WITH p AS ({PROFILE_SQL}), n AS (SELECT "column", max(n) AS top_n FROM (SELECT "column", v, count(*) AS n FROM cells WHERE "column" IN ('channel', 'urgent_flag') GROUP BY 1, 2) GROUP BY 1)
 SELECT "column", row_count, null_count, inferred_type, sentinel_count, min_value, max_value, true AS distinct_close, top_n, CAST(3 AS BIGINT) AS batches FROM p LEFT JOIN n USING ("column")""".replace(f"WITH p AS (WITH {WIDE} ", f"WITH {WIDE}, p AS (")),
    "profile_top": (profile_top, f"""WITH {WIDE}, n AS (SELECT "column", v AS value, count(*) AS n, min(row_number) AS f FROM cells WHERE v <> '' AND "column" <> 'member_id' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) AS rank FROM n) SELECT "column", CAST(rank AS INT) AS rank, value, n FROM r WHERE rank <= 10"""),
    "profile_samples": (profile_samples, f"""WITH {WIDE}, n AS (SELECT DISTINCT "column", v FROM cells WHERE v <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v) AS r FROM n) SELECT "column", string_agg(v, '|' ORDER BY v) AS sample FROM r WHERE r <= 5 GROUP BY 1"""),
    "profile_keys": (profile_keys, "SELECT count(*) AS row_count, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS n_keys FROM lineitem"),
    "profile_minimal": (profile_minimal, _minimal_sql()),
    "profile_files": (profile_files, f"""SELECT * FROM (VALUES ('role identifier', 'claim_id,member_id'), ('role date', 'service_date,claim_month'), ('role measure', 'allowed'), ('role dimension', 'status,priority,channel,urgent_flag'), ('role unclassified', 'spare')) t(fact, value), (SELECT true AS stable)
 UNION ALL SELECT 'coverage', strftime(min(o_orderdate), '%Y-%m-%d') || ' ' || strftime(max(o_orderdate), '%Y-%m-%d'), true FROM orders WHERE o_orderkey % 10 <> 0"""),
    "profile_batch": (profile_batch, f"""WITH {FEED}, w AS (SELECT * FROM feed ORDER BY row_number LIMIT 5000), n AS (SELECT (SELECT count(*) FROM feed) AS rows_in_batch, (SELECT count(*) FROM w) AS rows_profiled),
 c AS (UNPIVOT (SELECT status, claim_id, service_date, member_id, allowed, priority, channel FROM w) ON status, claim_id, service_date, member_id, allowed, priority, channel INTO NAME "column" VALUE v)
 SELECT CAST(list_position(['status', 'claim_id', 'service_date', 'member_id', 'allowed', 'priority', 'channel'], "column") - 1 AS INT) AS position, "column", count(*) AS row_count, count(*) FILTER (v = '') AS null_count, count(DISTINCT v) FILTER (v <> '') AS distinct_count,
 any_value(rows_in_batch) AS rows_in_batch, any_value(rows_profiled) AS rows_profiled, any_value(rows_profiled < rows_in_batch) AS is_sample FROM c, n GROUP BY "column" """),
    "dq_schema": (dq_schema, f"""WITH {WIDE}, now AS (SELECT "column", row_count, CASE WHEN "column" = 'status' THEN row_count ELSE null_count END AS null_count FROM facts WHERE "column" <> 'urgent_flag' UNION ALL SELECT 'extra', row_count, null_count FROM facts WHERE "column" = 'priority')
 SELECT CASE WHEN f."column" IS NULL THEN 'B-02' ELSE 'B-03' END AS rule_id, coalesce(n."column", f."column") AS "column", CASE WHEN f."column" IS NULL THEN 'observe' ELSE 'block' END AS action FROM now n FULL JOIN facts f ON n."column" = f."column"
 WHERE f."column" IS NULL OR n."column" IS NULL OR (f.null_count < f.row_count AND n.null_count = n.row_count)"""),
    "profile_drift": (profile_drift, "SELECT * FROM (VALUES ('claim_id', 'retyped', 'drift'), ('extra', 'added', 'drift'), ('spare', 'removed', 'drift'), ('spare', 'missing', 'contract'), ('extra', 'extra', 'contract')) t(\"column\", change, kind) WHERE EXISTS (SELECT 1 FROM orders)"),
    "profile_anomalies": (profile_anomalies, f"""WITH {WIDE} SELECT 'spare' AS "column", 'empty' AS signal, 1.0::DOUBLE AS share UNION ALL SELECT 'channel', 'constant', 1.0 UNION ALL SELECT 'status', 'null_rate', round(null_count / row_count, 4) FROM facts WHERE "column" = 'status'
 UNION ALL SELECT 'service_date', 'sentinel_heavy', round(count(*) FILTER (v = '9999-12-31') / count(*), 4) FROM cells WHERE "column" = 'service_date'"""),
    "profile_class": (profile_class, "SELECT 'care' AS domain, 'customer' AS dataset, CAST(3 AS BIGINT) AS matched, 'one row per c_custkey' AS grain WHERE EXISTS (SELECT 1 FROM customer)"),
}
