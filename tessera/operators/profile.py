"""Column and file facts of all-string tables: types, keys, roles, bounds, sentinels, drift and anomalies."""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import written

#: What a column's text looks like.
INT, DECIMAL, CODE = r"^[+-]?\d+$", r"^[+-]?\d*\.\d+$", r"^[A-Z0-9][A-Z0-9._-]{0,15}$"
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{8})$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}"
#: Days that could be: ISO, with or without a time of day, dense, and month first.
_M, _D = "(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
ISO_DAY, DENSE_DAY, OTHER_DAYS = rf"^\d{{4}}-{_M}-{_D}(\z|[ T]\d{{1,2}}:\d{{2}})", rf"^\d{{4}}{_M}{_D}\z", tuple(rf"^(0?[1-9]|1[0-2]){x}(0?[1-9]|[12]\d|3[01]){x}\d{{4}}\z" for x in "/-")
BOOL = ("true", "false", "t", "f", "yes", "no", "y", "n", "0", "1")
#: Names that hint at protected data and at roles, and placeholders for an unknown date or number.
PHI = ("name", "dob", "birth", "ssn", "mrn", "member_id", "memberid", "patient", "address", "addr", "street", "city", "zip", "postal", "phone", "email", "gender", "sex", "race", "ethnicity", "subscriber", "death", "deceased")
IDENTIFIER = ("id", "npi", "tin", "mrn", "ssn", "key", "identifier")
#: Names that hint at technical columns, labels and periods; the roles; how many values, keys and pairs are told.
TECHNICAL = ("created", "updated", "modified", "batch", "lsdeleted", "etl", "ingested", "loaded")
TECHNICAL_PHRASES = ("record_hash", "row_number", "source_system", "secure_id", "record_creation", "load_date", "load_ts")
LABEL = ("zip", "postal", "phone", "mobile", "fax", "number", "code", "flag", "status", "type", "indicator", "segtype")
PERIOD = ("month", "year", "period", "quarter", "yyyymm")
SENTINELS = ("1900-01-01", "9999-12-31", "0000-00-00", "1900-01-01 00:00:00", "9999-12-31 00:00:00", "01/01/1900", "12/31/9999", "19000101", "99991231")
ROLES = ("identifier", "date", "measure", "dimension", "technical", "unclassified")
#: Sets of columns whose sketches are made in one pass, a sketch's relative standard error, sets that are looked at exactly in one job, and rows of them a task holds.
PER_PASS, ERROR, TOGETHER, PER_TASK = 64, 0.02, 16, 2_000_000
#: One in how many of a set's values is looked at, look after look: what has repeats is mostly told by few of them, and only the rest is looked at whole.
SHARES = (64, 8, 1)
TOP, SAMPLES, FEW, FEW_SHARE, PAIR_COLUMNS, PAIRS = 10, 5, 50, 0.05, 8, 3


def unpivoted(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(row_number, position, column, phi, value)``: one row a cell, in one narrow pass; ``phi`` is told of a column's name, not of its cells."""
    names = columns or [c for c in rows.columns if c != "row_number"]
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), is_phi(F.lit(c)).alias("phi"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for i, c in enumerate(names)]
    return rows.select("row_number", F.inline(F.array(*cells)))


def is_phi(column: Column) -> Column:
    return F.replace(F.lower(column), F.lit(" "), F.lit("_")).rlike("|".join(PHI))


def is_sentinel(v: Column) -> Column:
    return F.trim(v).isin(*SENTINELS) | F.trim(v).rlike(r"^(0{4,}|9{4,})$")


def iso_date(v: Column) -> Column:
    """The day of a text ``yyyy-MM-dd``, ``M/d/yyyy``, ``M-d-yyyy`` or ``yyyyMMdd``, or of an ISO timestamp; else null.

    Only what its length and one match let through is put in ISO order and cast: parsers by pattern, and failing ones above all, cost many times as much.
    """
    t = F.trim(v)
    text = F.when(t.rlike(ISO_DAY), F.left(t, F.lit(10))).when(t.rlike(DENSE_DAY), F.regexp_replace(t, r"^(.{4})(..)(..)", "$1-$2-$3")).otherwise(F.regexp_replace(t, r"^(\d+).(\d+).(\d+)", "$3-$1-$2"))
    size = F.octet_length(t)
    return F.when((size.between(8, 10) | (size >= 15)) & t.rlike("|".join((ISO_DAY, DENSE_DAY, *OTHER_DAYS))), text).try_cast("date")


def _has(column: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(column), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in words]))


def looked_at(cells: DataFrame) -> DataFrame:
    """``cells`` with all that ``measures`` takes of a ``value``, each told once a cell: in the aggregates every sum and extreme would tell it anew.

    Lengths stand before matches where they settle most values. ``$`` also matches before a line's end of up to three bytes.
    """
    v, size = F.col("value"), F.octet_length("value")
    t = F.trim(v)
    start = t.startswith("0") | t.startswith("1") | t.startswith("9")
    told = cells.withColumns({
        "some": v != "", "int": v.rlike(INT), "decimal": v.contains(".") & v.rlike(DECIMAL), "dated": size.between(8, 13) & v.rlike(DATE), "stamp": (size >= 15) & v.rlike(TIMESTAMP),
        "bool": (size <= 5) & F.lower(v).isin(*BOOL), "code": (size <= 19) & v.rlike(CODE), "sentinel": start & is_sentinel(v),
    })
    real = F.col("some") & ~F.col("sentinel")
    return told.withColumns({"number": F.when(real & (F.col("int") | F.col("decimal")), v.try_cast("double")), "day": F.when(real, iso_date(v))})


def measures(n: Column) -> list[Column]:
    """What is known of a column from cells that were ``looked_at`` and occur ``n`` times: sums and extremes, which parts of a column add up to."""
    total = lambda c: F.sum(F.when(F.col("some") & F.col(c), n).otherwise(0))
    by = F.when(F.col("number").isNotNull(), F.struct(F.col("number").alias("x"), F.col("value").alias("v")))
    return [
        F.sum(n).alias("row_count"), F.sum(F.when(~F.col("some"), n).otherwise(0)).alias("null_count"), total("int").alias("ints"), total("decimal").alias("decimals"), total("dated").alias("dates"),
        total("stamp").alias("timestamps"), total("bool").alias("bools"), total("code").alias("codes"), total("sentinel").alias("sentinel_count"),
        F.min(by).alias("low"), F.max(by).alias("high"), F.min("day").alias("from"), F.max("day").alias("to"),
    ]


def column_facts(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column. ``rows`` has ``row_number``; missing is ``""``.

    Cells are first counted by (column, value), which combines before the shuffle and spreads a wide column over
    all tasks; facts are then sums over distinct values. Ties of top values go to the first seen.
    """
    values = unpivoted(rows, columns).groupBy("position", "column", "value").agg(F.count("*").alias("n"), F.min("row_number").alias("first"))
    return finished(looked_at(values).groupBy("position", "column").agg(*measures(F.col("n")), F.count_if("some").alias("distinct_count")))


def finished(facts: DataFrame) -> DataFrame:
    """``measures`` and ``distinct_count`` of columns to their facts."""
    filled = F.col("row_count") - F.col("null_count")
    share = lambda c: F.try_divide(F.col(c), filled)
    numbers = F.try_divide(F.col("ints") + F.col("decimals"), filled)
    code_like = F.coalesce(share("codes") >= 0.95, F.lit(False))
    kind = (
        F.when(filled == 0, "string").when(share("timestamps") >= 0.95, "timestamp").when(share("dates") >= 0.95, "date")
        .when((share("bools") >= 0.95) & (share("ints") < 0.95), "bool").when((share("decimals") >= 0.5) & (numbers >= 0.95), "decimal")
        .when(share("ints") >= 0.95, "int").when(code_like, "code").otherwise("string")
    )
    out = facts.withColumn("inferred_type", kind).withColumn("phi_candidate", is_phi(F.col("column"))).withColumn("code_like", code_like)
    bound = lambda x, d: F.when(F.col("phi_candidate"), None).when(F.col("inferred_type").isin("int", "decimal"), F.col(x)["v"]).when(F.col("inferred_type").isin("date", "timestamp"), F.date_format(d, "yyyy-MM-dd"))
    return out.select(
        "position", "column", "row_count", "null_count", F.round(F.coalesce(F.try_divide(F.col("null_count"), F.col("row_count")), F.lit(0.0)), 4).alias("null_ratio"),
        "distinct_count", (F.col("distinct_count") == 1).alias("constant"), "inferred_type", F.round(F.coalesce(numbers, F.lit(0.0)), 4).alias("numeric_ratio"),
        F.round(F.coalesce(share("dates"), F.lit(0.0)), 4).alias("date_ratio"), "code_like", "sentinel_count", "phi_candidate",
        bound("low", F.col("from")).alias("min_value"), bound("high", F.col("to")).alias("max_value"),
    )


def top_values(rows: DataFrame, columns: list[str] | None = None, k: int = TOP) -> DataFrame:
    """``(column, rank, value, n)``: the k most frequent values of each column that is not protected."""
    values = unpivoted(rows, columns).where("value <> '' and not phi").groupBy("column", "value").agg(F.count("*").alias("n"), F.min("row_number").alias("first"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "first")
    return values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def sample_values(rows: DataFrame, columns: list[str] | None = None, k: int = SAMPLES) -> DataFrame:
    """``(column, values)``: the first k of each column's sorted distinct values."""
    values = unpivoted(rows, columns).where("value <> ''").select("column", "value").distinct()
    first = values.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("rank") <= k)
    return first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))


def _unique(rows: DataFrame, sets: list[tuple[str, ...]], distinct: dict[str, int], n: int, enough: int | None = None) -> list[tuple[str, ...]]:
    """Those of ``sets`` of columns in which no two of the ``n`` rows agree, in their order; the first ``enough``, if given.

    Three sieves, each for what the one before lets through: columns whose distinct values cannot make ``n`` combinations; sketches of combinations, PER_PASS sets a
    pass, which no row is multiplied for (a key is missed at an error of six standard deviations); then an exact look for two rows that agree, by 128 bits of what they hold, TOGETHER sets a job, first among a share of the values, last among all.
    """
    able = [c for c in sets if prod(distinct[x] for x in c) >= n]
    named = lambda c: [F.col(f"`{x}`") for x in c]
    near: list[tuple[str, ...]] = []
    for at in range(0, len(able), PER_PASS):
        some = able[at : at + PER_PASS]
        told = rows.agg(*[F.approx_count_distinct(F.xxhash64(*named(c)), ERROR) for c in some]).first()
        near += [c for c, m in zip(some, told, strict=True) if m >= n * (1 - 6 * ERROR)]
    out: list[tuple[str, ...]] = []
    for at in range(0, len(near), TOGETHER):
        some = near[at : at + TOGETHER]
        for share in SHARES:
            some = _standing(rows, some, n, share) if some else some
        out += some
        if enough and len(out) >= enough:
            return out[:enough]
    return out


def _standing(rows: DataFrame, sets: list[tuple[str, ...]], n: int, share: int) -> list[tuple[str, ...]]:
    """Those of ``sets`` in which no two rows agree among one in ``share`` of what a set's rows hold; rows that agree hash alike, so they are looked at together or not at all.

    Partitions follow the rows, as rows of a key do not combine before the shuffle.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(sets) // share // PER_TASK)
    hashed = [F.xxhash64(*[F.col(f"`{x}`") for x in c]) for c in sets]
    each = [F.struct(F.lit(i).alias("i"), h.alias("h"), F.xxhash64(F.lit(7), *[F.col(f"`{x}`") for x in c]).alias("g")) for i, (c, h) in enumerate(zip(sets, hashed, strict=True))]
    picked = [F.when(F.pmod(h, F.lit(share)) == 0, s) for h, s in zip(hashed, each, strict=True)]
    looked = rows.select(F.explode(F.array_compact(F.array(*picked))).alias("s")).select("s.*").repartition(parts, "i", "h", "g")
    again = {r.i for r in looked.groupBy("i", "h", "g").agg(F.count("*").alias("m")).where("m > 1").select("i").distinct().collect()}
    return [c for i, c in enumerate(sets) if i not in again]


def candidate_keys(rows: DataFrame, facts: DataFrame) -> list[tuple[str, ...]]:
    """Complete and unique columns; only without any, the first pairs of complete columns that are unique."""
    told = facts.orderBy("position").select("column", "row_count", "null_count", "distinct_count").collect()
    complete = [r for r in told if not r.null_count and r.row_count]
    singles = [(r.column,) for r in complete if r.distinct_count == r.row_count]
    pairs = list(combinations([r.column for r in complete[:PAIR_COLUMNS]], 2))
    if singles or not pairs:
        return singles
    return _unique(rows, pairs, {r.column: r.distinct_count for r in complete}, complete[0].row_count, PAIRS)


def minimal_keys(rows: DataFrame, facts: DataFrame, largest: int = 3) -> list[tuple[str, ...]]:
    """All sets of up to ``largest`` complete columns that are unique and have no unique part, level by level, over any number of columns.

    A set is looked at only if none of its parts is a key, so a level's sets are those that the one below leaves. An empty table has no keys.
    """
    told = facts.orderBy("position").select("column", "row_count", "null_count", "distinct_count").collect()
    complete = [r for r in told if not r.null_count and r.row_count]
    if not complete:
        return []
    n, distinct = complete[0].row_count, {r.column: r.distinct_count for r in complete}
    keys = [(c,) for c, m in distinct.items() if m == n]
    for size in range(2, largest + 1):
        left = [c for c in distinct if (c,) not in keys]
        sets = [c for c in combinations(left, size) if not any(set(k) <= set(c) for k in keys)]
        keys += _unique(rows, sets, distinct, n)
    return keys


def with_roles(facts: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """``facts`` with ``role`` and ``importance``; rules in order of precedence."""
    c, kind, distinct = F.col("column"), F.col("inferred_type"), F.col("distinct_count")
    lowered = F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    keyed = c.isin(*[k for key in keys for k in key], "")
    unique = keyed | (F.col("code_like") & (distinct == F.col("row_count")))
    label = _has(c, LABEL)
    few = (distinct <= FEW) | (distinct / F.col("row_count") < FEW_SHARE)
    role = (
        F.when(_has(c, TECHNICAL) | lowered.rlike("|".join(TECHNICAL_PHRASES)), "technical").when(distinct == 0, "unclassified")
        .when(kind.isin("date", "timestamp") | ((kind == "int") & _has(c, PERIOD)), "date").when(_has(c, IDENTIFIER) | (unique & ~label), "identifier")
        .when(kind.isin("int", "decimal") & ~label, "measure").when(kind.isin("string", "code", "bool", "int") & few, "dimension").otherwise("unclassified")
    )
    out = facts.withColumn("in_key", keyed).withColumn("role", role)
    return out.withColumn("importance", F.when(F.col("role").isin("technical", "unclassified"), "low").when(F.col("in_key"), "high").otherwise("medium"))


def by_role(facts: DataFrame) -> DataFrame:
    """``(role, place, columns)`` in the fixed order of roles."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"])
    return facts.groupBy("role").agg(F.first(place).alias("place"), listed.alias("columns"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """``(row_count, duplicates)``: rows less distinct rows, by a 128-bit signature of the whole row."""
    names = [c for c in rows.columns if c != "row_number"]
    sign = F.md5(F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])))
    return rows.select(sign.alias("s")).groupBy("s").agg(F.count("*").alias("n")).agg(F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicates"))


def time_coverage(facts: DataFrame) -> DataFrame:
    """``(columns, from_date, to_date)`` over date columns that are neither protected nor technical."""
    dated = facts.where("role = 'date' and inferred_type in ('date', 'timestamp') and not phi_candidate and min_value is not null")
    return dated.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("columns"), F.min("min_value").alias("from_date"), F.max("max_value").alias("to_date"))


def profile_id(facts: DataFrame) -> DataFrame:
    """One content address of all facts, whatever the order of rows."""
    told = F.sha2(F.to_json(F.struct(*facts.columns)), 256)
    return facts.agg(F.left(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(told))), 256), F.lit(32)).alias("profile_id"))


def drift(latest: DataFrame, previous: DataFrame) -> DataFrame:
    """``(column, change)`` between two profiles: added, removed, retyped."""
    j = latest.select("column", F.col("inferred_type").alias("now")).join(previous.select("column", F.col("inferred_type").alias("was")), "column", "full_outer")
    return j.select("column", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "retyped").alias("change")).where("change is not null")


def contract_drift(observed: DataFrame, registered: DataFrame) -> DataFrame:
    """``(column, change)``: expected columns missing, and extra ones."""
    missing = registered.select("column").join(observed.select("column"), "column", "left_anti").withColumn("change", F.lit("missing"))
    return missing.union(observed.select("column").join(registered.select("column"), "column", "left_anti").withColumn("change", F.lit("extra")))


def order_verdicts(observed: list[str], registered: DataFrame) -> DataFrame:
    """``(rule_id, column, expected, found, action)``: B-01 warns of each registered column ``(column, place)`` that does not stand where it should among those that are there."""
    spark = registered.sparkSession
    there = spark.createDataFrame([(c, i) for i, c in enumerate(observed)], "column string, at int")
    # Places among the common columns alone: what is new or gone is B-02's and B-03's. Columns of one table fit one window.
    both = registered.join(there, "column").withColumn("expected", F.row_number().over(Window.orderBy("place"))).withColumn("found", F.row_number().over(Window.orderBy("at")))
    return both.where("expected <> found").select(F.lit("B-01").alias("rule_id"), "column", "expected", "found", F.lit("warn").alias("action"))


def schema_verdicts(observed: DataFrame, registered: DataFrame) -> DataFrame:
    """``(rule_id, column, action)`` of two profiles: a new column is observed; a column that is gone, or is all null now and was not
    before, blocks."""
    filled = lambda t, name: t.select("column", (F.col("null_count") < F.col("row_count")).alias(name))
    j = filled(observed, "now").join(filled(registered, "was"), "column", "full_outer")
    rule = F.when(F.col("was").isNull(), "B-02").when(F.col("now").isNull() | (F.col("was") & ~F.col("now")), "B-03")
    return j.select(rule.alias("rule_id"), "column", F.when(rule == "B-02", "observe").otherwise("block").alias("action")).where("rule_id is not null")


def batch_profile(bronze: DataFrame, column_order: list[str], sample_rows: int = 5000) -> DataFrame:
    """``column_facts`` of a Bronze batch's first ``sample_rows`` rows by number, with ``rows_in_batch``, ``rows_profiled`` and ``is_sample``.

    The window is the feature: a bounded look, marked as such. Known columns stand in the order given, drifted ones behind them by name.
    """
    total = bronze.count()
    some = written(bronze.orderBy("row_number").limit(sample_rows), "window")
    present = {r[0] for r in some.select(F.explode(F.map_keys("raw_row"))).distinct().collect()}  # names of columns
    names = [c for c in column_order if c in present] + sorted(present - set(column_order))
    rows = some.select("row_number", *[F.coalesce(F.try_element_at("raw_row", F.lit(c)), F.lit("")).alias(c) for c in names])
    seen = min(total, sample_rows)
    return column_facts(rows).withColumns({"rows_in_batch": F.lit(total).cast("long"), "rows_profiled": F.lit(seen).cast("long"), "is_sample": F.lit(seen < total)})


def anomalies(facts: DataFrame, null_rate: float = 0.5, sentinel_rate: float = 0.05) -> DataFrame:
    """``(column, signal, share)``: empty, null-rate, constant, and sentinel-heavy columns."""
    filled = F.col("row_count") - F.col("null_count")
    empty = F.col("null_count") == F.col("row_count")
    signals = F.array_compact(F.array(
        F.when(empty, F.struct(F.lit("empty").alias("signal"), F.lit(1.0).alias("share"))),
        F.when(~empty & (F.col("null_ratio") >= null_rate), F.struct(F.lit("null_rate").alias("signal"), F.col("null_ratio").alias("share"))),
        F.when(F.col("constant") & (F.col("row_count") > 1) & (F.col("role") != "technical"), F.struct(F.lit("constant").alias("signal"), F.lit(1.0).alias("share"))),
        F.when((F.col("role") == "date") & (F.col("sentinel_count") / filled >= sentinel_rate), F.struct(F.lit("sentinel_heavy").alias("signal"), F.round(F.col("sentinel_count") / filled, 4).alias("share"))),
    ))
    return facts.where("row_count > 0").select("column", F.inline(signals))


def classify_feed(facts: DataFrame, feeds: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """``(domain, dataset, matched, grain)``: the registered feed ``(domain, dataset, column)`` most of whose columns are here, and the grain that keys give."""
    matched = feeds.join(facts.select("column"), "column", "left_semi").groupBy("domain", "dataset").agg(F.count("*").alias("matched"))
    grain = "one row per " + " and ".join(keys[0]) if keys else "no key found"
    best = matched.orderBy(F.col("matched").desc(), "domain", "dataset").limit(1)
    return best.withColumn("grain", F.lit(grain))
