"""One data-quality engine: rules are rows of a catalog, kinds are Column builders, actions decide rows and tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import NULL_TOKENS, code_list, npi_valid, null_tokens

ACTIONS = ("block", "quarantine", "warn", "observe")
#: Older severity words.
LEGACY = {"critical": "block", "high": "quarantine", "medium": "warn", "low": "observe", "info": "observe"}
#: Shapes of common fields.
SHAPES = {"zip": r"^\d{5}(-?\d{4})?$", "phone": r"^\+?1?[-. (]*\d{3}[-. )]*\d{3}[-. ]*\d{4}$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "icd10": r"^[A-TV-Z]\d[A-Z0-9](\.?[A-Z0-9]{1,4})?$", "ndc": r"^\d{4,5}-?\d{3,4}-?\d{1,2}$", "id": r"^[A-Za-z0-9-]+$"}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    column: str
    action: str = "warn"
    params: dict = field(default_factory=dict)


def failed(rule: Rule) -> Column:
    """Whether a row fails a row-level rule. Nulls fail only where the kind says so."""
    c, p = F.col(rule.column), rule.params
    if rule.kind == "present":
        return null_tokens(c.cast("string")).isNull()
    if rule.kind == "shape":
        return c.isNotNull() & (~npi_valid(c) if p["shape"] == "npi" else ~c.rlike(SHAPES[p["shape"]]))
    if rule.kind == "pattern":
        return c.isNotNull() & ~c.rlike(p["pattern"])
    if rule.kind == "in":
        return c.isNotNull() & ~c.isin(*p["values"])
    if rule.kind == "range":
        return ((c < p["low"]) if "low" in p else F.lit(False)) | ((c > p["high"]) if "high" in p else F.lit(False))
    if rule.kind == "order":
        return F.coalesce(c > F.col(p["then"]), F.lit(False))
    if rule.kind == "relation":
        return F.coalesce(F.abs(c - F.expr(p["equals"])) > p.get("tolerance", 0), F.lit(False))
    if rule.kind == "implies":
        return F.coalesce(F.expr(p["when"]) & ~F.expr(p["then"]), F.lit(False))
    if rule.kind == "null_token":
        return F.upper(F.trim(c)).isin(*[t for t in NULL_TOKENS if t])
    raise ValueError(f"{rule.kind} is no row-level kind")


def action_of(rule: Rule, exceptions: dict[tuple[str, str], str], feed: str, months: int) -> str:
    """The action that holds for a feed: exceptions first; rules with thresholds observe until three months of history exist."""
    action = exceptions.get((rule.rule_id, feed), LEGACY.get(rule.action, rule.action))
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action}")
    return "observe" if rule.params.get("needs_history") and months < 3 else action


def flagged(rows: DataFrame, rules: list[Rule], exceptions: dict | None = None, feed: str = "", months: int = 12) -> DataFrame:
    """``rows`` with ``failures`` (rule id and action of each failed rule) and ``verdict``: block, quarantine, warn or pass. One narrow pass."""
    hits = [F.when(failed(r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(action_of(r, exceptions or {}, feed, months)).alias("action"))) for r in rules]
    out = rows.withColumn("failures", F.array_compact(F.array(*hits)))
    any_ = lambda a: F.exists("failures", lambda f: f["action"] == a)
    return out.withColumn("verdict", F.when(any_("block"), "block").when(any_("quarantine"), "quarantine").when(any_("warn"), "warn").otherwise("pass"))


def rule_counts(flagged_rows: DataFrame) -> DataFrame:
    return flagged_rows.select(F.inline("failures")).groupBy("rule_id", "action").agg(F.count("*").alias("n"))


def gate(flagged_rows: DataFrame) -> DataFrame:
    """One row ``(n_rows, blocked, quarantined, warned, verdict)`` for the table."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = flagged_rows.agg(F.count("*").alias("n_rows"), n("block").alias("blocked"), n("quarantine").alias("quarantined"), n("warn").alias("warned"))
    return out.withColumn("verdict", F.when(F.col("blocked") > 0, "blocked").when(F.col("quarantined") > 0, "partial").otherwise("open"))


def unmapped_values(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``(value, n)`` outside the code set ``(code)``: counted first, then looked up, so the join sees distinct values only."""
    seen = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return seen.join(codes.select(F.col("code").alias("value")), "value", "left_anti")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once; keys with a null part are not evaluable and left out."""
    return rows.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def repeat_census(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(n_rows, distinct_rows, extra)``: repeats observed by hash, none removed."""
    sign = F.xxhash64(*columns)
    return rows.groupBy(sign.alias("h"), *columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("extra"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent, kept whole."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def uncovered(events: DataFrame, spans: DataFrame, key: str, at: str, days: int = 32) -> DataFrame:
    """Events outside every span ``(key, from_date, to_date)`` of their key.

    A range join as an equality on the key and on buckets of ``days``, so one long-lived key does not meet all its spans.
    """
    width = F.lit(days)
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / width)
    cut = spans.withColumn("bucket", F.explode(F.sequence(bucket("from_date"), bucket("to_date")))).select(key, "bucket", "from_date", "to_date")
    marked = events.withColumn("bucket", bucket(at)).alias("e")
    inside = (F.col(f"e.{key}") == F.col(f"s.{key}")) & (F.col("e.bucket") == F.col("s.bucket")) & F.col(f"e.{at}").between(F.col("s.from_date"), F.col("s.to_date"))
    return marked.join(cut.alias("s"), inside, "left_anti").drop("bucket")


def volume_bands(volumes: DataFrame, width: float = 3.0, back: int = 3) -> DataFrame:
    """``(feed, period, n, mean, spread, verdict)``: each volume against the ``back`` periods before; fewer observe only."""
    w = Window.partitionBy("feed").orderBy("period").rowsBetween(-back, -1)
    out = volumes.withColumn("mean", F.avg("n").over(w)).withColumn("spread", F.stddev_samp("n").over(w)).withColumn("seen", F.count("n").over(w))
    off = F.abs(F.col("n") - F.col("mean")) > width * F.greatest(F.col("spread"), F.lit(1.0))
    return out.withColumn("verdict", F.when(F.col("seen") < back, "observe").when(off, "out_of_band").otherwise("in_band")).drop("seen")


def seasonal_bands(volumes: DataFrame, season: Column, width: float = 3.0, back: int = 3) -> DataFrame:
    """``volume_bands`` against the same ``season`` (a month of the year, say) of up to ``back`` rounds before; fewer than two observe only."""
    w = Window.partitionBy("feed", "season").orderBy("period").rowsBetween(-back, -1)
    out = volumes.withColumn("season", season).withColumn("mean", F.avg("n").over(w)).withColumn("spread", F.stddev_samp("n").over(w)).withColumn("seen", F.count("n").over(w))
    off = F.abs(F.col("n") - F.col("mean")) > width * F.greatest(F.col("spread"), F.lit(1.0))
    return out.withColumn("verdict", F.when(F.col("seen") < 2, "observe").when(off, "out_of_band").otherwise("in_band")).drop("seen")


def derivable_tokens(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``primary_code`` (the first token of a list that is kept as it came), ``tokens``, and A-16's ``verdict``: a list that says something, but no code, is observed."""
    codes = code_list(F.col(column))
    out = rows.withColumn("primary_code", F.get(codes, F.lit(0))).withColumn("tokens", F.coalesce(F.size(codes), F.lit(0)))
    told = F.coalesce(F.trim(F.col(column)), F.lit("")) != ""
    return out.withColumn("verdict", F.when(told & F.col("primary_code").isNull(), "observe").otherwise("pass"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measure: str, tolerance: float = 0.0) -> DataFrame:
    """``(keys, left_value, right_value, delta, status)`` of two aggregates of the same measure."""
    j = left.select(*keys, F.col(measure).alias("left_value")).join(right.select(*keys, F.col(measure).alias("right_value")), keys, "full_outer")
    delta = F.coalesce("left_value", F.lit(0)) - F.coalesce("right_value", F.lit(0))
    status = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").when(F.abs(delta) > tolerance, "differs").otherwise("agrees")
    return j.withColumn("delta", delta).withColumn("status", status)


def missing_periods(rows: DataFrame, key: str, period: str, step: str = "1 month") -> DataFrame:
    """Periods between a key's first and last that it lacks."""
    spans = rows.groupBy(key).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    every = spans.select(key, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(period))
    return every.join(rows.select(key, period).distinct(), [key, period], "left_anti")


def manifest_checks(manifest: DataFrame, pattern: str, minutes: int = 60) -> DataFrame:
    """``(file, unknown_name, repeated, late, mismatch)`` of ``(file, checksum, expected_checksum, due, received)``."""
    first = F.min("received").over(Window.partitionBy("checksum"))
    return manifest.select(
        "file", (~F.col("file").rlike(pattern)).alias("unknown_name"), (F.col("received") > first).alias("repeated"),
        (F.col("received") > F.col("due") + F.expr(f"interval {minutes} minutes")).alias("late"),
        F.coalesce(F.col("checksum") != F.col("expected_checksum"), F.lit(False)).alias("mismatch"),
    )


def one_value(rows: DataFrame, by: str, column: str) -> DataFrame:
    """``(by, n_values, ok)``: files that should hold one value only."""
    return rows.groupBy(by).agg(F.count_distinct(column).alias("n_values")).withColumn("ok", F.col("n_values") == 1)


def overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans ``(keys, from_date, to_date)`` that begin before an earlier one of their keys has ended."""
    before = Window.partitionBy(*keys).orderBy("from_date", "to_date").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("to_date").over(before)).where("from_date <= reach").drop("reach")


def merge_hazards(people: DataFrame) -> DataFrame:
    """Household signatures shared by several people: same last name, birth date and address, different first names."""
    return people.groupBy("last", "dob", "address").agg(F.count("*").alias("n"), F.count_distinct("first").alias("firsts")).where("firsts > 1")


def crosswalk_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(source_id, person_key, kind)``: pairs an append-only crosswalk has lost, and keys given to another person after they had been retired."""
    lost = before.join(after, ["source_id", "person_key"], "left_anti").select("source_id", "person_key", F.lit("lost").alias("kind"))
    retired = before.groupBy("person_key").agg(F.max("retired").alias("gone")).where("gone")
    reused = after.join(before.select("source_id", "person_key"), ["source_id", "person_key"], "left_anti").join(retired, "person_key", "left_semi")
    return lost.union(reused.select("source_id", "person_key", F.lit("reused").alias("kind")))
