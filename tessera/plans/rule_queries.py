"""Data-quality rules and change over deliveries, over the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.operators import change as C
from tessera.operators import rules as R
from tessera.plans.core_queries import table

RULES = [
    R.Rule("Q1", "present", "segment", "quarantine"),
    R.Rule("Q2", "pattern", "name", "warn", {"pattern": r"^Customer#\d{8}[0-8]$"}),
    R.Rule("Q3", "in", "segment", "high", {"values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]}),
    R.Rule("Q4", "order", "start", "warn", {"then": "stop"}),
    R.Rule("Q5", "range", "balance", "block", {"low": -990.0}),
    R.Rule("Q5b", "relation", "balance", "observe", {"equals": "round(balance)", "tolerance": 0.25}),
    R.Rule("Q14", "implies", "balance", "low", {"when": "balance < 0", "then": "segment = 'BUILDING'"}),
    R.Rule("Q16", "null_token", "segment", "observe"),
    R.Rule("Q2z", "shape", "zip", "warn", {"shape": "zip"}),
]


def _people(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        k, F.col("c_name").alias("name"), F.when(k % 11 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 50).cast("int")).alias("start"), F.date_add(F.lit("2020-02-01").cast("date"), (k % 7).cast("int")).alias("stop"), F.concat(F.lpad((k % 1000).cast("string"), 4, "0"), F.when(k % 9 == 0, "x").otherwise("1")).alias("zip"),
    )


PEOPLE = """people AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'N/A' ELSE c_mktsegment END AS segment, c_acctbal AS balance, c_custkey % 50 AS a, 31 + c_custkey % 7 AS b, c_custkey % 9 = 0 AS badzip FROM customer),
hits AS (SELECT k, segment = 'N/A' AS q1, name LIKE '%9' AS q2, segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') AS q3, a > b AS q4, balance < -990 AS q5, abs(balance - round(balance)) > 0.25 AS q5b, balance < 0 AND segment <> 'BUILDING' AS q14, segment = 'N/A' AS q16, badzip AS q2z FROM people),
judged AS (SELECT *, CASE WHEN q5 THEN 'block' WHEN q1 OR q3 THEN 'quarantine' WHEN q4 OR q2z OR q2 THEN 'warn' ELSE 'pass' END AS verdict FROM hits)"""


def dq_verdicts(spark, d):
    """Q1 to Q5, Q14, Q16, Q19: row verdicts under an exception and legacy words."""
    out = R.flagged(_people(spark, d), RULES)
    return out.select("c_custkey", "verdict", F.size("failures").alias("n_failures"))


def dq_counts(spark, d):
    return R.rule_counts(R.flagged(_people(spark, d), RULES, {("Q5", "vip"): "warn"}, "vip"))


def dq_gate(spark, d):
    return R.gate(R.flagged(_people(spark, d), RULES))


def dq_unmapped(spark, d):
    """Q3: values outside a code set of the table's own making."""
    codes = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("code"))
    return R.unmapped_values(table(spark, d, "customer"), "c_nationkey", codes)


def dq_repeats(spark, d):
    """Q6."""
    return R.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def dq_census(spark, d):
    """Q7."""
    return R.repeat_census(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


def dq_orphans(spark, d):
    """Q8: order lines whose order is not among those of 1997."""
    o = table(spark, d, "orders").where(F.year("o_orderdate") == 1997)
    return R.orphans(table(spark, d, "lineitem"), o, "l_orderkey", "o_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def _spans(spark, d):
    """Coverage spans from orders: a member is covered from each order for some weeks."""
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select(F.col("o_custkey").alias("member"), F.col("o_orderstatus").alias("plan"), day.alias("from_date"), F.date_add(day, (F.col("o_orderkey") % 120).cast("int")).alias("to_date"), "o_orderkey")


SPANS = "spans AS (SELECT o_custkey AS member, o_orderstatus AS plan, CAST(o_orderdate AS DATE) AS from_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INT) AS to_date, o_orderkey FROM orders)"


def dq_uncovered(spark, d):
    """Q8 as a range join: line items shipped to a member outside any coverage."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("member"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"))
    events = l.join(o, l.l_orderkey == o.o_orderkey)
    return R.uncovered(events, _spans(spark, d), "member", "shipped").groupBy("member").agg(F.count("*").alias("n"))


def dq_volumes(spark, d):
    """Q9."""
    v = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("feed"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(F.count("*").alias("n"))
    out = R.volume_bands(v, width=1.5)
    return out.select("feed", F.col("period").cast("string").alias("period"), "n", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "verdict")


def dq_seasonal(spark, d):
    """Q9, L-07: each month's orders against the same month of the years before."""
    v = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("feed"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(F.count("*").alias("n"))
    out = R.seasonal_bands(v, F.month("period"), width=1.5)
    return out.select("feed", F.col("period").cast("string").alias("period"), "n", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "verdict")


def dq_tokens(spark, d):
    """Q20, A-16: lists of codes kept as they came, their first code, and lists without one."""
    e, k = table(spark, d, "events"), F.col("event_id")
    listed = F.when(k % 5 == 0, F.concat(F.lit(" a0"), k % 7, F.lit(".1, B99 ;"))).when(k % 5 == 1, " ,; ").when(k % 5 == 2, "").when(k % 5 == 3, F.concat(F.lit(";E11."), k % 9, F.lit("|z00")))
    return R.derivable_tokens(e.select("event_id", listed.alias("list")), "list")


def dq_layout(spark, d):
    """Q11, B-01, B-10: regions' files with a row too long, with a quoted delimiter, with a row too short; and columns out of their order."""
    from tessera.plans.core_queries import landed_text
    from tessera.sources import landing as L

    n = table(spark, d, "nation")
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    line = F.when(key == "3", F.concat_ws("|", key, name, F.lit("x"))).when(key == "4", F.concat(key, F.lit('|"a|b"'))).when(key == "5", key).otherwise(F.concat_ws("|", key, name))
    path = landed_text(spark, n.select(F.concat(F.lit("file"), F.col("n_regionkey")).alias("file"), line.alias("line")), "key|name")
    cells = L.cell_verdicts(spark, f"{path}/*").select("rule_id", F.regexp_extract("file", r"/file=(\w+)/", 1).alias("subject"), "cells", "expected", "n_rows", "action")
    places = table(spark, d, "region").select(F.col("r_name").alias("column"), F.col("r_regionkey").alias("place"))
    order = [r[0] for r in table(spark, d, "region").orderBy(F.col("r_name").desc()).select("r_name").collect()]
    from tessera.operators import profile as P

    moved = P.order_verdicts(order, places).select("rule_id", F.col("column").alias("subject"), F.col("found").alias("cells"), "expected", F.lit(1).cast("long").alias("n_rows"), "action")
    return cells.unionByName(moved)


def dq_reconcile(spark, d):
    """Q10: order totals against line totals, by order status."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = o.groupBy("o_orderkey").agg(F.sum(F.lit(1).cast("long")).alias("n"))
    b = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return R.reconcile(a, b, ["o_orderkey"], "n").groupBy("status").agg(F.count("*").alias("n_orders"), F.sum("delta").alias("delta"))


def dq_gaps(spark, d):
    """Q12, V4: months without an order between a member's first and last."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("member"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period"))
    return R.missing_periods(o, "member", "period").groupBy("member").agg(F.count("*").alias("missing"))


def dq_manifest(spark, d):
    """Q13, L-02 to L-08: events as a manifest of files."""
    e = table(spark, d, "events")
    m = e.select(F.concat(F.col("event_type"), F.lit("_"), F.col("event_id"), F.lit(".csv")).alias("file"), F.md5(F.concat_ws("|", "user_id", "value")).alias("checksum"), F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.md5(F.concat_ws("|", "user_id", "value"))).alias("expected_checksum"), F.date_trunc("day", "ts").alias("due"), F.col("ts").alias("received"))
    out = R.manifest_checks(m, r"^(view|click|purchase|signup)_\d+\.csv$", minutes=720)
    return out.agg(*[F.count_if(c).alias(c) for c in ("unknown_name", "late", "mismatch")])


def dq_single(spark, d):
    """Q15."""
    return R.one_value(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus").groupBy("ok").agg(F.count("*").alias("n"))


def dq_overlaps(spark, d):
    """Q17."""
    return R.overlapping(_spans(spark, d), ["member", "plan"]).groupBy("plan").agg(F.count("*").alias("n"))


def dq_hazards(spark, d):
    """Q18: households that look like one person."""
    c = table(spark, d, "customer")
    p = c.select(F.col("c_name").alias("first"), F.col("c_mktsegment").alias("last"), (F.col("c_custkey") % 40).alias("dob"), F.col("c_nationkey").alias("address"))
    return R.merge_hazards(p)


def dq_crosswalk(spark, d):
    """Q18: pairs lost and keys reused between two versions."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    before = c.select("source_id", (F.col("source_id") % 100).alias("person_key"), (F.col("source_id") % 100 == 7).alias("retired"))
    after = c.where("source_id % 10 <> 3").select("source_id", F.when(F.col("source_id") % 100 == 8, F.lit(7).cast("long")).otherwise(F.col("source_id") % 100).alias("person_key"))
    return R.crosswalk_breaks(before, after).groupBy("kind").agg(F.count("*").alias("n"))


def change_diff(spark, d):
    """V1, V2: a snapshot against one with rows gone, come and changed."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    after = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return C.snapshot_diff(c.where("c_custkey % 9 <> 0"), after, ["c_custkey"], ["c_name", "c_acctbal"])


def change_versions(spark, d):
    """V2: corrections in place become versions."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    now = c.where("c_custkey % 2 = 0").withColumn("version", F.lit(1))
    fix = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, -1.0).otherwise(F.col("c_acctbal")))
    return C.new_versions(now, fix, ["c_custkey"], ["c_name", "c_acctbal"])


def change_latest(spark, d):
    """V3, V7: the latest restatement of each line, with what it collapsed."""
    l = table(spark, d, "lineitem")
    return C.latest(l, ["l_orderkey", "l_linenumber"], F.col("l_shipdate").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "collapsed")


def change_spans(spark, d):
    """Effective spans, and what was valid on a day as known then."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("valid_from")).agg(F.max("o_orderkey").alias("version"))
    s = C.effective_spans(o, ["o_custkey"], "valid_from").withColumn("known_from", F.date_add("valid_from", 10)).withColumn("known_to", F.lit(None).cast("date"))
    day = F.lit("1998-06-30").cast("date")
    return C.as_of(s, day, day).select("o_custkey", "version", "is_current")


def change_survivors(spark, d):
    """V6: attributes by precedence of their source."""
    o = table(spark, d, "orders")
    v = o.groupBy(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("source")).agg(F.max("o_orderpriority").alias("value")).withColumn("attribute", F.lit("priority"))
    place = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source")).distinct().where("source <> 'P'").select(F.lit("priority").alias("attribute"), "source", F.when(F.col("source") == "O", 1).otherwise(2).alias("place"))
    return C.survivors(v, place).select("key", "value", "source", F.array_join("others", ";").alias("others"))


def change_deliveries(spark, d):
    """V8: evidence from yearly deliveries of each member's latest order status."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("member"), F.year("o_orderdate").alias("delivery")).agg(F.max("o_orderstatus").alias("status"))
    return C.deliveries(o, ["member"], ["status"])


def change_islands(spark, d):
    """Merged coverage with gaps."""
    out = C.merged_spans(_spans(spark, d), ["member"], 1)
    return out.select("member", "island", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"), "n_spans", "gap_before")


def change_months(spark, d):
    """Member months, prorated."""
    out = C.member_months(_spans(spark, d), ["member"])
    return out.select("member", F.col("month").cast("string").alias("month"), "days", "share")


ISLANDS = """w AS (SELECT *, max(to_date) OVER (PARTITION BY member ORDER BY from_date, to_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR from_date - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY member ORDER BY from_date, to_date ROWS UNBOUNDED PRECEDING) AS island FROM w),
islands AS (SELECT member, island, min(from_date) AS from_date, max(to_date) AS to_date, count(*) AS n_spans FROM i GROUP BY 1, 2)"""
MONTHS = f"""{SPANS}, {ISLANDS}, mspan AS (SELECT member, from_date, to_date, unnest(generate_series(date_trunc('month', from_date), date_trunc('month', to_date), INTERVAL 1 MONTH)) AS month FROM islands),
months AS (SELECT member, CAST(month AS DATE) AS month, CAST(sum(date_diff('day', greatest(from_date, CAST(month AS DATE)), least(to_date, last_day(month))) + 1) AS INT) AS days FROM mspan GROUP BY 1, 2)"""
QUERIES = {
    "dq_verdicts": (dq_verdicts, f"WITH {PEOPLE} SELECT k AS c_custkey, verdict, CAST(CAST(q1 AS INT) + CAST(q2 AS INT) + CAST(q3 AS INT) + CAST(q4 AS INT) + CAST(q5 AS INT) + CAST(q5b AS INT) + CAST(q14 AS INT) + CAST(q16 AS INT) + CAST(q2z AS INT) AS INT) AS n_failures FROM judged"),
    "dq_counts": (dq_counts, f"WITH {PEOPLE}, t AS (SELECT 'Q1' AS rule_id, 'quarantine' AS action, count(*) FILTER (q1) AS n FROM hits UNION ALL SELECT 'Q2', 'warn', count(*) FILTER (q2) FROM hits UNION ALL SELECT 'Q3', 'quarantine', count(*) FILTER (q3) FROM hits UNION ALL SELECT 'Q4', 'warn', count(*) FILTER (q4) FROM hits UNION ALL SELECT 'Q5', 'warn', count(*) FILTER (q5) FROM hits UNION ALL SELECT 'Q5b', 'observe', count(*) FILTER (q5b) FROM hits UNION ALL SELECT 'Q14', 'observe', count(*) FILTER (q14) FROM hits UNION ALL SELECT 'Q16', 'observe', count(*) FILTER (q16) FROM hits UNION ALL SELECT 'Q2z', 'warn', count(*) FILTER (q2z) FROM hits) SELECT * FROM t WHERE n > 0"),
    "dq_gate": (dq_gate, f"WITH {PEOPLE} SELECT count(*) AS n_rows, count(*) FILTER (verdict = 'block') AS blocked, count(*) FILTER (verdict = 'quarantine') AS quarantined, count(*) FILTER (verdict = 'warn') AS warned, CASE WHEN count(*) FILTER (verdict = 'block') > 0 THEN 'blocked' WHEN count(*) FILTER (verdict = 'quarantine') > 0 THEN 'partial' ELSE 'open' END AS verdict FROM judged"),
    "dq_unmapped": (dq_unmapped, "SELECT c_nationkey AS value, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1"),
    "dq_repeats": (dq_repeats, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "dq_census": (dq_census, "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)"),
    "dq_orphans": (dq_orphans, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997) GROUP BY 1"),
    "dq_uncovered": (dq_uncovered, f"WITH {SPANS} SELECT o.o_custkey AS member, count(*) AS n FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.member = o.o_custkey AND CAST(l_shipdate AS DATE) BETWEEN s.from_date AND s.to_date) GROUP BY 1"),
    "dq_volumes": (dq_volumes, """WITH v AS (SELECT o_orderstatus AS feed, date_trunc('month', o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1, 2),
 w AS (SELECT *, avg(n) OVER p AS mean, stddev_samp(n) OVER p AS spread, count(n) OVER p AS seen FROM v WINDOW p AS (PARTITION BY feed ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
 SELECT feed, strftime(period, '%Y-%m-%d') AS period, n, round(mean, 6) AS mean, round(spread, 6) AS spread, CASE WHEN seen < 3 THEN 'observe' WHEN abs(n - mean) > 1.5 * greatest(spread, 1) THEN 'out_of_band' ELSE 'in_band' END AS verdict FROM w"""),
    "dq_seasonal": (dq_seasonal, """WITH v AS (SELECT o_orderstatus AS feed, date_trunc('month', o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1, 2),
 w AS (SELECT *, avg(n) OVER p AS mean, stddev_samp(n) OVER p AS spread, count(n) OVER p AS seen FROM v WINDOW p AS (PARTITION BY feed, month(period) ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
 SELECT feed, strftime(period, '%Y-%m-%d') AS period, n, round(mean, 6) AS mean, round(spread, 6) AS spread, CASE WHEN seen < 2 THEN 'observe' WHEN abs(n - mean) > 1.5 * greatest(spread, 1) THEN 'out_of_band' ELSE 'in_band' END AS verdict FROM w"""),
    "dq_tokens": (dq_tokens, """WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' a0' || event_id % 7 || '.1, B99 ;' WHEN 1 THEN ' ,; ' WHEN 2 THEN '' WHEN 3 THEN ';E11.' || event_id % 9 || '|z00' END AS list FROM events),
 t AS (SELECT *, list_filter([upper(replace(trim(x), '.', '')) for x in regexp_split_to_array(list, '[,;|]')], lambda x: x <> '') AS codes FROM l)
 SELECT event_id, list, codes[1] AS primary_code, CAST(coalesce(len(codes), 0) AS INT) AS tokens, CASE WHEN trim(coalesce(list, '')) <> '' AND codes[1] IS NULL THEN 'observe' ELSE 'pass' END AS verdict FROM t"""),
    "dq_layout": (dq_layout, """WITH n AS (SELECT 'file' || n_regionkey AS subject, CASE n_nationkey WHEN 3 THEN 3 WHEN 5 THEN 1 END AS cells FROM nation), r AS (SELECT r_name AS subject, row_number() OVER (ORDER BY r_name DESC) AS found, row_number() OVER (ORDER BY r_regionkey) AS expected FROM region)
 SELECT 'B-10' AS rule_id, subject, CAST(cells AS INT) AS cells, CAST(2 AS INT) AS expected, count(*) AS n_rows, 'block' AS action FROM n WHERE cells IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'B-01', subject, CAST(found AS INT), CAST(expected AS INT), CAST(1 AS BIGINT), 'warn' FROM r WHERE found <> expected"""),
    "dq_reconcile": (dq_reconcile, """WITH a AS (SELECT o_orderkey, CAST(1 AS BIGINT) AS n FROM orders), b AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT a.n AS x, b.n AS y FROM a FULL JOIN b USING (o_orderkey))
 SELECT CASE WHEN x IS NULL THEN 'right_only' WHEN y IS NULL THEN 'left_only' WHEN x <> y THEN 'differs' ELSE 'agrees' END AS status, count(*) AS n_orders, CAST(sum(coalesce(x, 0) - coalesce(y, 0)) AS BIGINT) AS delta FROM j GROUP BY 1"""),
    "dq_gaps": (dq_gaps, """WITH o AS (SELECT DISTINCT o_custkey AS member, date_trunc('month', o_orderdate) AS period FROM orders), s AS (SELECT member, count(*) AS have, date_diff('month', min(period), max(period)) + 1 AS span FROM o GROUP BY 1)
 SELECT member, CAST(span - have AS BIGINT) AS missing FROM s WHERE span > have"""),
    "dq_manifest": (dq_manifest, "SELECT count(*) FILTER (event_type = 'error') AS unknown_name, count(*) FILTER (ts > date_trunc('day', ts) + INTERVAL 720 MINUTE) AS late, count(*) FILTER (event_id % 50 = 0) AS mismatch FROM events"),
    "dq_single": (dq_single, "SELECT n = 1 AS ok, count(*) AS n FROM (SELECT l_orderkey, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1) GROUP BY 1"),
    "dq_overlaps": (dq_overlaps, f"WITH {SPANS}, w AS (SELECT *, max(to_date) OVER (PARTITION BY member, plan ORDER BY from_date, to_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans) SELECT plan, count(*) AS n FROM w WHERE from_date <= reach GROUP BY 1"),
    "dq_hazards": (dq_hazards, "SELECT c_mktsegment AS last, c_custkey % 40 AS dob, c_nationkey AS address, count(*) AS n, count(DISTINCT c_name) AS firsts FROM customer GROUP BY 1, 2, 3 HAVING count(DISTINCT c_name) > 1"),
    "dq_crosswalk": (dq_crosswalk, "SELECT 'lost' AS kind, count(*) AS n FROM customer WHERE c_custkey % 10 = 3 OR c_custkey % 100 = 8 UNION ALL SELECT 'reused', count(*) FROM customer WHERE c_custkey % 100 = 8"),
    "change_diff": (change_diff, """WITH a AS (SELECT * FROM customer WHERE c_custkey % 9 <> 0), b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0)
 SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'new' WHEN b.c_custkey IS NULL THEN 'ended' WHEN a.c_acctbal <> b.c_acctbal THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.c_custkey = b.c_custkey"""),
    "change_versions": (change_versions, "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM customer WHERE c_custkey % 2 <> 0 OR (c_custkey % 4 = 0 AND c_acctbal <> -1.0)"),
    "change_latest": (change_latest, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n - 1 AS collapsed FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1"),
    "change_spans": (change_spans, """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS f, max(o_orderkey) AS version FROM orders GROUP BY 1, 2), s AS (SELECT *, lead(f) OVER (PARTITION BY o_custkey ORDER BY f) AS t FROM o)
 SELECT o_custkey, version, t IS NULL AS is_current FROM s WHERE f <= DATE '1998-06-30' AND (t IS NULL OR t > DATE '1998-06-30') AND f + 10 <= DATE '1998-06-30'"""),
    "change_survivors": (change_survivors, """WITH v AS (SELECT o_custkey AS key, o_orderstatus AS source, max(o_orderpriority) AS value, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS p FROM orders GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p) AS r FROM v) SELECT key, max(value) FILTER (r = 1) AS value, max(source) FILTER (r = 1) AS source, coalesce(string_agg(source || '=' || value, ';' ORDER BY source) FILTER (r > 1), '') AS others FROM r GROUP BY 1"""),
    "change_deliveries": (change_deliveries, """WITH o AS (SELECT o_custkey AS member, CAST(year(o_orderdate) AS INT) AS delivery, max(o_orderstatus) AS status FROM orders GROUP BY 1, 2), n AS (SELECT delivery, count(*) AS n FROM o GROUP BY 1),
 j AS (SELECT a.delivery, count(*) AS n, count(b.member) AS kept, count(*) FILTER (b.status <> a.status) AS changed FROM o a LEFT JOIN o b ON b.delivery = a.delivery - 1 AND a.member = b.member GROUP BY 1)
 SELECT j.delivery, j.n, kept, n.n - kept AS vanished, changed, CASE WHEN kept / n.n < 0.1 THEN 'append' WHEN kept / n.n >= 0.5 AND changed / greatest(kept, 1) > 0.2 THEN 'restated' ELSE 'snapshot' END AS archetype FROM j JOIN n ON n.delivery = j.delivery - 1"""),
    "change_islands": (change_islands, f"WITH {SPANS}, {ISLANDS} SELECT member, CAST(island AS INT) AS island, CAST(from_date AS VARCHAR) AS from_date, CAST(to_date AS VARCHAR) AS to_date, n_spans, CAST(from_date - lag(to_date) OVER (PARTITION BY member ORDER BY island) - 1 AS INT) AS gap_before FROM islands"),
    "change_months": (change_months, f"WITH {MONTHS} SELECT member, CAST(month AS VARCHAR) AS month, days, round(days / day(last_day(month)), 6) AS share FROM months"),
}
