"""Schema matching, ledgers and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import ledger as L
from tessera.operators import mapping as M
from tessera.operators import matching as X
from tessera.plans.core_queries import SPEC, feed, table
from tessera.plans.scratch import shared_dir
from tessera.streaming import feeds as T


def _columns(spark, d):
    """Source columns of many feeds, from part names: a feed a brand, columns named by words."""
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("feed"), F.initcap("p_name").alias("column")).distinct()


def _glossary(spark, d):
    """Terms with an alias, for part names that end in certain words."""
    p = table(spark, d, "part").select("p_name").distinct().where("p_name rlike '(ring|bolt|widget)$'")
    word = F.element_at(F.split("p_name", " "), -1)
    return p.select(F.upper("p_name").alias("term"), F.array(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("aliases"), F.concat(word, F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("target"))


def _canonical(spark, d):
    p = table(spark, d, "part").select("p_name", "p_type").distinct()
    return p.select(F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("target")).distinct()


COLUMNS = """cols AS (SELECT DISTINCT p_brand AS feed, p_name AS raw, array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], ' ') AS "column" FROM part),
gl AS (SELECT DISTINCT p_name AS raw, string_split(p_name, ' ')[-1] || '.' || replace(p_name, ' ', '_') AS target FROM part WHERE regexp_matches(p_name, '(ring|bolt|widget)$'))"""


def match_glossary(spark, d):
    """X1."""
    return X.glossary_match(_columns(spark, d), _glossary(spark, d))


def match_hints(spark, d):
    """Decisions in free text, and approvals of several feeds merged."""
    c = table(spark, d, "customer")
    text = F.concat(F.lit("we agreed that col"), F.col("c_custkey") % 40, F.lit(" -> seg."), F.lower("c_mktsegment"), F.lit(" and nothing else"))
    hints = X.decision_hints(c.select(F.col("c_custkey").alias("record_id"), text.alias("text")))
    a = c.select(F.concat(F.lit("col"), F.col("c_custkey") % 40).alias("column"), F.lower("c_mktsegment").alias("target"), F.col("c_custkey").alias("decided_at"))
    late = X.approved_history(a.where("decided_at % 2 = 0"), a.where("decided_at % 2 = 1"))
    return hints.join(late.withColumnRenamed("target", "approved"), "column")


def match_ladder(spark, d):
    """The best rung of every column, and status counts."""
    cols, canonical = _columns(spark, d), _canonical(spark, d)
    glossary = _glossary(spark, d).select(F.replace(F.lower("term"), F.lit(" "), F.lit("_")).alias("column"), "target")
    found = X.match_ladder(cols, {"glossary": glossary}, canonical)
    return X.status_counts(found).join(found.groupBy("feed").agg(F.count("*").alias("n_columns"), F.count("target").alias("n_matched")), "feed")


def match_lexical(spark, d):
    """Misspelt columns find the concept they came from."""
    cols = _columns(spark, d).withColumn("column", F.regexp_replace("column", "g$", ""))
    concepts = table(spark, d, "part").select(F.col("p_name").alias("concept"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("target")).distinct()
    return X.lexical_matches(cols, concepts).select("feed", "column", "target", "score", "rank")


def match_compound(spark, d):
    """Columns spelt as one word, and shortened ones, find the concept of several words."""
    p = table(spark, d, "part")
    cols = p.select(F.col("p_brand").alias("feed"), F.regexp_replace(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), "(.)e(.)", "$1$2").alias("column")).distinct()
    concepts = p.select(F.col("p_name").alias("concept"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("target")).distinct()
    return X.lexical_matches(cols, concepts).select("feed", "column", "target", "score", "rank")


#: The longest common block, the first of its length; then what lies on both sides of it, again.
COMPOUND_SQL = """WITH RECURSIVE cols AS (SELECT DISTINCT p_brand AS feed, array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], '') AS raw FROM part),
 c AS (SELECT DISTINCT feed, regexp_replace(raw, '(.)e(.)', '\\1\\2', 'g') AS "column" FROM cols), k AS (SELECT DISTINCT p_name AS concept FROM part),
 p AS (SELECT DISTINCT lower("column") AS x, replace(concept, ' ', '') AS y FROM c, k),
 t AS (SELECT x, y, x AS a, y AS b, 0 AS n FROM p
  UNION ALL SELECT x, y, unnest([a[:-m.i - 1], a[m.l - m.i:]]), unnest([b[:-m.j - 1], b[m.l - m.j:]]), unnest([m.l, 0]) FROM (SELECT *, list_max(flatten([[CASE WHEN strpos(b, a[i:i + l - 1]) > 0 THEN {'l': l, 'i': -i, 'j': -strpos(b, a[i:i + l - 1])} END for l in range(1, len(a) - i + 2)] for i in range(1, len(a) + 1)])) AS m FROM t WHERE a <> '' AND b <> '') WHERE m IS NOT NULL),
 s AS (SELECT x, y, round(2 * sum(n) / (length(x) + length(y)), 6) AS score FROM t GROUP BY 1, 2),
 f AS (SELECT feed, "column", replace(concept, ' ', '_') AS target, score FROM c, k, s WHERE x = lower("column") AND y = replace(concept, ' ', '') AND score >= 0.55),
 r AS (SELECT *, row_number() OVER (PARTITION BY feed, "column" ORDER BY score DESC, target) AS rank FROM f) SELECT feed, "column", target, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"""


def match_policy(spark, d):
    """Illegal targets, precedents, and suggested transforms."""
    cols = _columns(spark, d).select("feed", "column", F.concat(F.lit("a."), F.replace(F.lower("column"), F.lit(" "), F.lit("_"))).alias("target"), F.when(F.length("column") % 2 == 0, "lexical").otherwise("leaf").alias("basis"), F.lit("candidate").alias("status"))
    canonical = cols.select("target").distinct().where("target rlike 'ring|bolt'")
    ruled = cols.where("column rlike '^Red'").select("column", F.lit("a.red_bolt").alias("target")).distinct()
    out = X.with_policy(cols, canonical, ruled)
    kind = F.when(F.length("column") % 3 == 0, "date").otherwise("string")
    want = F.when(F.length("column") % 2 == 0, "timestamp_utc").otherwise("bool")
    return out.groupBy("status", X.suggested_transform(kind, want).alias("transform")).agg(F.count("*").alias("n"))


def match_seed(spark, d):
    """A spec seeded from matches, keys it lacks, and the roster of columns."""
    p = table(spark, d, "part")
    cand = p.groupBy(F.col("p_name").alias("column")).agg(F.concat(F.min("p_type"), F.lit("."), F.max("p_brand")).alias("target")).withColumn("status", F.when(F.length("column") % 5 == 0, "ambiguous").otherwise("candidate"))
    canon = p.select(F.concat(F.col("p_type"), F.lit("."), F.col("p_brand")).alias("target"), F.col("p_type").alias("entity")).distinct()
    types = canon.withColumn("type", F.when(F.col("target").endswith("1"), "int64").otherwise("string"))
    spec = M.seeded(cand, types)
    keys = M.required_targets(canon.withColumn("is_key", F.col("target").endswith("#7")).withColumn("system", F.lit(False)), spec.select("target"))
    profile = p.select(F.col("p_name").alias("column")).distinct().withColumn("inferred_type", F.lit("string"))
    issues = p.groupBy(F.col("p_name").alias("column")).agg(F.count_if(F.col("p_size") > 45).alias("issues"))
    out = X.roster(profile, cand, spec.select(F.col("column").alias("source"), "target"), issues)
    n = keys.agg(F.count("*").alias("missing_keys")).withColumn("all", F.lit(1))
    tot = out.groupBy("placed").agg(F.count("*").alias("n"), F.sum("issues").alias("issues"), F.count("candidate").alias("candidates")).withColumn("all", F.lit(1))
    return tot.join(F.broadcast(n), "all").drop("all")


def _steps(spark, d):
    """Events as a step ledger: a user is a batch, a kind is a step."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 7 == 1, "running").otherwise("completed")
    return e.select(F.col("user_id").alias("batch_id"), F.col("event_type").alias("step"), F.col("event_id").cast("long").alias("generation"), status.alias("status"), F.col("ts").alias("at"), (F.col("event_type") == "click").alias("is_gate"), F.when(F.col("event_id") % 2 == 0, "bronze").otherwise("silver").alias("kind"))


STEPS = "st AS (SELECT user_id AS batch_id, event_type AS step, event_id AS generation, CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status, ts AS tm, event_type = 'click' AS is_gate, CASE WHEN event_id % 2 = 0 THEN 'bronze' ELSE 'silver' END AS kind FROM events)"


def ledger_latest(spark, d):
    """Every declared step at its newest generation."""
    declared = table(spark, d, "events").select(F.col("event_type").alias("step")).distinct().withColumn("position", F.length("step"))
    return L.step_progress(declared, _steps(spark, d).where("batch_id % 3 > 0 or step <> 'view'"))


def ledger_lineage(spark, d):
    """L2, L3, L4: run states, first approvals, chains."""
    s = _steps(spark, d)
    manifest = s.select("batch_id").distinct().withColumn("file", F.concat(F.lit("f"), F.col("batch_id")))
    approvals = s.where("is_gate").select("batch_id", F.when(F.col("generation") % 2 == 0, "G1").otherwise("G2").alias("gate"), F.concat(F.lit("u"), F.col("generation") % 5).alias("approver"), "at")
    out = L.lineage(manifest, L.run_state(s), approvals)
    return out.select("batch_id", "file", "bronze", "silver", F.col("G1").alias("g1"), F.col("G2").alias("g2"), "complete")


def ledger_versions(spark, d):
    """L5."""
    v = _steps(spark, d).select(F.col("step").alias("feed"), F.col("generation").alias("version"), F.when(F.col("status") == "completed", "approved").otherwise("draft").alias("status"))
    return L.superseded(v).groupBy("feed", "effective_status").agg(F.count("*").alias("n"), F.max("next_version").alias("next_version"))


def ledger_worklist(spark, d):
    """L6."""
    s = _steps(spark, d)
    items = s.where("status = 'running'").select(F.col("generation").alias("item"), F.col("step").alias("gate"), F.col("at").alias("waiting_since"))
    done = s.where("generation % 4 = 0").select(F.col("generation").alias("item"), F.col("step").alias("gate"))
    return L.worklist(items, done).select("item", "gate", "waiting", "rank")


def ledger_attention(spark, d):
    """Newest trouble, failures first."""
    return L.sorted_by(L.attention(_steps(spark, d), 20), F.col("generation"), True, "batch_id").select("batch_id", "step", "status", "generation")


def ledger_transitions(spark, d):
    """L10."""
    s = _steps(spark, d)
    legal = s.select("status").distinct().withColumnRenamed("status", "was").where("was <> 'completed'").join(F.broadcast(s.select("status").distinct())).select("was", "status")
    return L.illegal_transitions(s, legal, "batch_id", ["at", "generation"]).groupBy("was", "status").agg(F.count("*").alias("n"))


def _stream(spark, d):
    """Events as a file stream of the given table."""
    path, schema = f"{d}/events.parquet", table(spark, d, "events").schema
    rows = T.file_stream(spark, path, schema) if _is_folder(spark, path) else T.file_stream(spark, d, schema, pathGlobFilter="events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def stream_ingest(spark, d):
    """Every event once, with lateness kept."""
    s = _stream(spark, d).withColumn("received", F.col("ts") + F.make_interval(mins=F.col("event_id") % 90))
    return T.drained(T.lateness(s, "ts", "received", 3600), "ingest").groupBy("is_late").agg(F.count("*").alias("n"), F.sum("late_seconds").alias("seconds"))


def stream_dedup(spark, d):
    """Deliveries of which every third is repeated within the delay, each event once."""
    s = _stream(spark, d)
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(40), F.lit(300))).otherwise(F.array(F.lit(0)))
    s = s.select("*", F.explode(again).alias("later")).withColumn("ts", F.col("ts") + F.make_interval(mins="later"))
    s = T.deduplicated(s, ["event_id"], "ts", "1 day")
    return T.drained(s, "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_volumes(spark, d):
    """T4: counts by hour, complete."""
    s = T.volumes(_stream(spark, d), "ts", ["event_type"], "1 hour")
    return T.drained(s, "volumes", "complete").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def stream_sessions(spark, d):
    """T5: sessions by a gap of two hours, complete."""
    s = T.sessions(_stream(spark, d), "ts", ["user_id"], "2 hours")
    return T.drained(s, "sessions", "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def stream_stays(spark, d):
    """Closed and timed-out stays from state and timers. What is still open when the stream ends is not put out; state machines are beyond SQL."""
    s = T.open_stays(_stream(spark, d), "user_id", "ts", "event_type", "signup", "purchase", 3)
    with T.keyed_state(spark):
        out = T.drained(s, "stays")
    return out.groupBy("state").agg(F.count("*").alias("n"))


def stream_census(spark, d):
    """The current row of each user, upserted by bucket; a second run over the same files changes nothing."""
    path = f"{shared_dir(spark)}/tessera/census-{uuid.uuid4().hex}"
    for _ in range(2):
        T.drained(_stream(spark, d).select("user_id", "event_id", "ts", "event_type"), "census", each=T.upsert(path, ["user_id"], ["ts", "event_id"]))
    return spark.read.parquet(path).select("user_id", "event_id", "event_type")


def stream_promotion(spark, d):
    """Micro-batches promoted with their balance rows."""
    base = f"{shared_dir(spark)}/tessera/promotion-{uuid.uuid4().hex}"
    rows = feed(spark, d)
    rows.repartitionByRange(4, "row_number").write.parquet(f"{base}/in")
    results: list = []
    s = T.file_stream(spark, f"{base}/in", rows.schema, files_per_batch=2)
    T.drained(s, "promotion", each=T.promoting(SPEC, f"{base}/out", "live", results))
    told = spark.createDataFrame([tuple(r["balance"][k] for k in ("records_in", "records_out", "quarantined", "drops")) for r in results], "records_in long, records_out long, quarantined long, drops long")
    written = M.published(spark, f"{base}/out", "claim_header").agg(F.count("*").alias("headers")).withColumn("all", F.lit(1))
    return told.agg(*[F.sum(c).alias(c) for c in told.columns]).withColumn("all", F.lit(1)).join(written, "all").drop("all")


from tessera.plans.core_queries import FEED  # noqa: E402

QUERIES = {
    "match_glossary": (match_glossary, f'WITH {COLUMNS} SELECT feed, "column", target FROM cols LEFT JOIN gl USING (raw)'),
    "match_hints": (match_hints, """WITH h AS (SELECT 'col' || (c_custkey % 40) AS "column", min_by('seg.' || lower(c_mktsegment), c_custkey) AS target, max_by(lower(c_mktsegment), c_custkey) AS approved FROM customer GROUP BY 1) SELECT * FROM h"""),
    "match_ladder": (match_ladder, f"""WITH {COLUMNS}, cn AS (SELECT p_name AS raw, count(DISTINCT p_type) AS n, min(lower(p_type) || '.' || replace(p_name, ' ', '_')) AS target FROM part GROUP BY 1),
 b AS (SELECT feed, "column", coalesce(gl.target, cn.target) AS target, CASE WHEN gl.target IS NOT NULL THEN 1 ELSE cn.n END AS n FROM cols LEFT JOIN gl USING (raw) LEFT JOIN cn USING (raw)),
 s AS (SELECT *, CASE WHEN target IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'candidate' END AS status FROM b), f AS (SELECT feed, count(*) AS n_columns, count(target) AS n_matched FROM s GROUP BY 1)
 SELECT feed, status, count(*) AS n, any_value(n_columns) AS n_columns, any_value(n_matched) AS n_matched FROM s JOIN f USING (feed) GROUP BY 1, 2"""),
    "match_lexical": (match_lexical, f"""WITH {COLUMNS}, c AS (SELECT DISTINCT feed, regexp_replace("column", 'g$', '') AS "column" FROM cols), k AS (SELECT DISTINCT p_name AS concept FROM part),
 p AS (SELECT feed, "column", replace(concept, ' ', '_') AS target, list_distinct(string_split(lower("column"), ' ')) AS a, list_distinct(string_split(concept, ' ')) AS b FROM c, k), s AS (SELECT feed, "column", target, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY feed, "column" ORDER BY score DESC, target) AS rank FROM s WHERE score >= 0.55) SELECT feed, "column", target, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"""),
    "match_compound": (match_compound, COMPOUND_SQL),
    "match_policy": (match_policy, f"""WITH {COLUMNS}, t AS (SELECT *, length("column") AS n, CASE WHEN raw LIKE 'red%' THEN 'red_bolt' ELSE replace(raw, ' ', '_') END AS target, raw LIKE 'red%' AS ruled FROM cols), legal AS (SELECT DISTINCT replace(raw, ' ', '_') AS target FROM cols WHERE raw LIKE '%ring%' OR raw LIKE '%bolt%'),
 s AS (SELECT n, CASE WHEN ruled AND l.target IS NOT NULL THEN 'candidate' WHEN l.target IS NULL THEN 'unknown' WHEN n % 2 = 0 THEN 'ambiguous' ELSE 'candidate' END AS status FROM t LEFT JOIN legal l USING (target))
 SELECT status, CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 'parse_date' WHEN n % 2 <> 0 THEN 'cast bool' END AS transform, count(*) AS n FROM s GROUP BY 1, 2"""),
    "match_seed": (match_seed, """WITH c AS (SELECT p_name AS col, min(p_type) || '.' || max(p_brand) AS target, length(p_name) % 5 <> 0 AS ok, count(*) FILTER (p_size > 45) AS issues FROM part GROUP BY 1), canon AS (SELECT DISTINCT p_type AS entity, p_type || '.' || p_brand AS target FROM part),
 o AS (SELECT col, c.target, count(*) OVER (PARTITION BY c.target) AS claims FROM c JOIN canon USING (target) WHERE ok), s AS (SELECT * FROM o WHERE claims = 1), kk AS (SELECT entity, min(target) AS target FROM canon WHERE target LIKE '%#7' GROUP BY 1 HAVING count(*) = 1),
 m AS (SELECT count(*) AS missing_keys FROM kk WHERE entity IN (SELECT string_split(target, '.')[1] FROM s) AND target NOT IN (SELECT target FROM s))
 SELECT s.col IS NOT NULL AS placed, count(*) AS n, CAST(sum(issues) AS BIGINT) AS issues, count(c.target) AS candidates, any_value(missing_keys) AS missing_keys FROM m, c LEFT JOIN s ON c.col = s.col GROUP BY 1"""),
    "ledger_latest": (ledger_latest, f"""WITH {STEPS}, u AS (SELECT * FROM st WHERE batch_id % 3 > 0 OR step <> 'view'), n AS (SELECT batch_id, step, max(generation) AS generation, max_by(status, generation) AS status FROM u GROUP BY 1, 2), x AS (SELECT DISTINCT b.batch_id, s.step FROM u b, (SELECT DISTINCT event_type AS step FROM events) s)
 SELECT x.batch_id, CAST(length(x.step) AS INT) AS position, x.step, coalesce(generation, 0) AS generation, coalesce(status, 'not_reached') AS status FROM x LEFT JOIN n USING (batch_id, step)"""),
    "ledger_lineage": (ledger_lineage, f"""WITH {STEPS}, r AS (SELECT batch_id, max_by(status, tm) FILTER (kind = 'bronze') AS bronze, max_by(status, tm) FILTER (kind = 'silver') AS silver, min_by('u' || (generation % 5), tm) FILTER (is_gate AND generation % 2 = 0) AS g1, min_by('u' || (generation % 5), tm) FILTER (is_gate AND generation % 2 = 1) AS g2 FROM st GROUP BY 1)
 SELECT batch_id, 'f' || batch_id AS file, bronze, silver, g1, g2, coalesce(bronze = 'completed' AND silver = 'completed', false) AS complete FROM r"""),
    "ledger_versions": (ledger_versions, f"""WITH {STEPS}, v AS (SELECT step AS feed, generation, status = 'completed' AS ok, max(generation) FILTER (status = 'completed') OVER (PARTITION BY step) AS top, max(generation) OVER (PARTITION BY step) + 1 AS nxt FROM st)
 SELECT feed, CASE WHEN NOT ok THEN 'draft' WHEN generation < top THEN 'superseded' ELSE 'approved' END AS effective_status, count(*) AS n, max(nxt) AS next_version FROM v GROUP BY 1, 2"""),
    "ledger_worklist": (ledger_worklist, f"WITH {STEPS}, w AS (SELECT generation AS item, step AS gate, count(*) OVER (PARTITION BY step) AS waiting, row_number() OVER (PARTITION BY step ORDER BY tm DESC, generation) AS rank FROM st WHERE status = 'running' AND generation % 4 <> 0) SELECT item, gate, waiting, CAST(rank AS INT) AS rank FROM w WHERE rank <= 8"),
    "ledger_attention": (ledger_attention, f"WITH {STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY tm DESC, step DESC) AS r FROM st) SELECT batch_id, step, status, generation FROM l WHERE r = 1 AND NOT is_gate AND status <> 'completed' ORDER BY status <> 'failed', tm DESC, batch_id LIMIT 20"),
    "ledger_transitions": (ledger_transitions, f"WITH {STEPS}, m AS (SELECT status, lag(status) OVER (PARTITION BY batch_id ORDER BY tm, generation) AS was FROM st) SELECT was, status, count(*) AS n FROM m WHERE was = 'completed' AND status <> 'completed' GROUP BY 1, 2"),
    "stream_ingest": (stream_ingest, "SELECT (event_id % 90) * 60 > 3600 AS is_late, count(*) AS n, CAST(sum((event_id % 90) * 60) AS BIGINT) AS seconds FROM events GROUP BY 1"),
    "stream_dedup": (stream_dedup, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "stream_volumes": (stream_volumes, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1"),
    "stream_stays": (stream_stays, None),
    "stream_census": (stream_census, "SELECT user_id, max_by(event_id, ts) AS event_id, max_by(event_type, ts) AS event_type FROM events GROUP BY 1"),
    "stream_promotion": (stream_promotion, f"WITH {FEED} SELECT count(*) AS records_in, count(*) FILTER (outcome = 'ok') AS records_out, count(*) FILTER (outcome <> 'ok') AS quarantined, CAST(0 AS BIGINT) AS drops, count(*) FILTER (outcome = 'ok') AS headers FROM done"),
}
#: The whole table, where the SQL above keeps a part.
