"""Deliveries over time: diffs, versions, spans, survivorship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``(key, change)``: new, ended, changed, unchanged. One join, on the key and the columns' hash."""
    a = before.select(*key, row_hash(columns).alias("was"))
    b = after.select(*key, row_hash(columns).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "ended").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def new_versions(current: DataFrame, delivery: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Delivery rows that are new or corrected, with the version number that they get. ``current`` has ``version``."""
    last = current.groupBy(*key).agg(F.max("version").alias("last"), F.max_by(row_hash(columns), "version").alias("was"))
    rows = delivery.withColumn("now", row_hash(columns)).join(last, key, "left")
    return rows.where("was is null or was <> now").withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last", "was", "now")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in ``order``; ``collapsed`` counts those behind it."""
    w = Window.partitionBy(*key)
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("_n", n).withColumn("collapsed", F.count("*").over(w) - 1).where("_n = 1").drop("_n")


def effective_spans(rows: DataFrame, key: list[str], start: str) -> DataFrame:
    """Versions as spans: ``valid_to`` is the next start (null while current), ``is_current``."""
    end = F.lead(start).over(Window.partitionBy(*key).orderBy(start))
    return rows.withColumn("valid_to", end).withColumn("is_current", F.col("valid_to").isNull())


def as_of(spans: DataFrame, valid: Column, known: Column) -> DataFrame:
    """What was valid at one time as it was known at another, of ``(valid_from, valid_to, known_from, known_to)``; open ends are null."""
    during = lambda a, b, t: (F.col(a) <= t) & (F.col(b).isNull() | (t < F.col(b)))
    return spans.where(during("valid_from", "valid_to", valid) & during("known_from", "known_to", known))


def survivors(values: DataFrame, precedence: DataFrame) -> DataFrame:
    """``(key, attribute, value, source, others)``: each attribute's value of the source that ranks first, the others kept beside.

    ``values`` (key, attribute, source, value), ``precedence`` (attribute, source, place); sources without a place come last.
    """
    ranked = values.where("value is not null").join(precedence, ["attribute", "source"], "left")
    by = F.struct(F.coalesce("place", F.lit(1 << 30)).alias("p"), F.col("source").alias("s"), F.col("value").alias("v"))
    out = ranked.groupBy("key", "attribute").agg(F.min(by).alias("first"), F.array_sort(F.collect_set(F.struct("source", "value"))).alias("all"))
    rest = F.filter("all", lambda x: x["source"] != F.col("first.s"))
    return out.select("key", "attribute", F.col("first.v").alias("value"), F.col("first.s").alias("source"), F.transform(rest, lambda x: F.concat_ws("=", x["source"], x["value"])).alias("others"))


def deliveries(rows: DataFrame, key: list[str], columns: list[str], periods: int = 0) -> DataFrame:
    """``(delivery, n, kept, vanished, changed, archetype)``: evidence from each delivery and the one before, and what it suggests."""
    marked = rows.select("delivery", *key, row_hash(columns).alias("h"))
    order = marked.select("delivery").distinct().withColumn("before", F.lag("delivery").over(Window.orderBy("delivery")))
    a = marked.join(F.broadcast(order), "delivery")
    b = marked.select(F.col("delivery").alias("before"), *key, F.col("h").alias("was"))
    met = a.join(b, ["before", *key], "left")
    now = met.groupBy("delivery", "before").agg(F.count("*").alias("n"), F.count("was").alias("kept"), F.count_if(F.col("was").isNotNull() & (F.col("h") != F.col("was"))).alias("changed"))
    sizes = marked.groupBy(F.col("delivery").alias("before")).agg(F.count("*").alias("n_before"))
    out = now.where("before is not null").join(sizes, "before").withColumn("vanished", F.col("n_before") - F.col("kept"))
    share = F.col("kept") / F.col("n_before")
    kind = F.when(share < 0.1, "append").when((share >= 0.5) & (F.col("changed") / F.greatest("kept", F.lit(1)) > 0.2), "restated").otherwise("snapshot")
    return out.select("delivery", "n", "kept", "vanished", "changed", kind.alias("archetype"))


def merged_spans(spans: DataFrame, keys: list[str], gap_days: int = 1) -> DataFrame:
    """Islands of ``(keys, from_date, to_date)``: spans that overlap or lie at most ``gap_days`` apart become one; ``n_spans``, ``gap_before`` in days."""
    w = Window.partitionBy(*keys).orderBy("from_date", "to_date")
    reach = F.max("to_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.datediff("from_date", reach) > gap_days)).cast("int")
    islands = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*keys, "island").agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date"), F.count("*").alias("n_spans"))
    last = F.lag("to_date").over(Window.partitionBy(*keys).orderBy("island"))
    return out.withColumn("gap_before", F.datediff("from_date", last) - 1).select(*keys, F.col("island").cast("int").alias("island"), "from_date", "to_date", "n_spans", "gap_before")


def member_months(spans: DataFrame, keys: list[str], convention: str = "prorated") -> DataFrame:
    """``(keys, month, days, share)`` of each month that spans touch; days of overlapping spans count once.

    Share is 1 for any day (``any``), for the 15th (``mid``), or days over the month's days (``prorated``).
    """
    one = merged_spans(spans, keys)
    months = one.withColumn("month", F.explode(F.sequence(F.trunc("from_date", "month"), F.trunc("to_date", "month"), F.expr("interval 1 month"))))
    first, last = F.greatest("from_date", "month"), F.least("to_date", F.last_day("month"))
    middle = F.col("month") + F.expr("interval 14 days")
    cut = months.withColumn("d", F.datediff(last, first) + 1).withColumn("mid", (F.col("from_date") <= middle) & (middle <= F.col("to_date")))
    out = cut.groupBy(*keys, "month").agg(F.sum("d").cast("int").alias("days"), F.max("mid").alias("mid"))
    share = {"any": F.lit(1.0), "mid": F.col("mid").cast("double"), "prorated": F.round(F.col("days") / F.day(F.last_day("month")), 6)}[convention]
    return out.select(*keys, "month", "days", share.alias("share"))
