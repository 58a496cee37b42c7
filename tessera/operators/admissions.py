"""Admission, discharge and transfer events: duplicates, groups, cancellations, stays, readmissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The event that each cancellation takes back.
CANCELS = {"A11": "A01", "A12": "A02", "A13": "A03"}


def exact_duplicates(events: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """``is_duplicate`` for all but the first event of an identity."""
    return events.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)) > 1)


def tolerance_duplicates(events: DataFrame, identity: list[str], ts: str, seconds: int, tie: str) -> DataFrame:
    """Events of an identity that follow the one before within ``seconds`` share ``burst``; all but its first are duplicates."""
    w = Window.partitionBy(*identity).orderBy(ts, tie)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    out = events.withColumn("is_duplicate", F.coalesce(gap <= seconds, F.lit(False)))
    return out.withColumn("burst", F.sum((~F.col("is_duplicate")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def encounter_group(events: DataFrame) -> DataFrame:
    """``group_id``: member and visit, else member and admission day."""
    day = F.date_format("admission_ts", "yyyyMMdd")
    return events.withColumn("group_id", F.concat_ws("|", "member", F.coalesce(F.nullif(F.trim("visit"), F.lit("")), day)))


def sequenced(events: DataFrame, group: str, ts: str, tie: str) -> DataFrame:
    """``seq`` within the group, and ``is_current`` for its latest event that is no duplicate."""
    w = Window.partitionBy(group)
    seq = F.row_number().over(w.orderBy(ts, tie))
    late = F.max(F.when(~F.col("is_duplicate"), F.struct(ts, tie))).over(w)
    return events.withColumn("seq", seq).withColumn("is_current", F.coalesce(late.eqNullSafe(F.struct(ts, tie)) & ~F.col("is_duplicate"), F.lit(False)))


def without_cancelled(events: DataFrame, group: str, ts: str, tie: str) -> DataFrame:
    """Events that stand: a cancellation takes back the latest earlier event of its kind that none has taken back yet; both go.

    Brackets that match: with +1 for an event and -1 for its cancellation, the pair shares a level of the running sum.
    """
    kinds = F.create_map(*[F.lit(x) for kv in CANCELS.items() for x in kv])
    undo = F.try_element_at(kinds, F.col("event_type"))
    rows = events.withColumn("_kind", F.coalesce(undo, F.col("event_type"))).withColumn("_undo", undo.isNotNull())
    w = Window.partitionBy(group, "_kind").orderBy(ts, tie)
    level = F.sum(F.when(F.col("_undo"), -1).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_level", level + F.col("_undo").cast("int"))
    pair = Window.partitionBy(group, "_kind", "_level").orderBy(ts, tie)
    taken = F.coalesce(~F.col("_undo") & F.lead("_undo").over(pair), F.lit(False))
    return rows.withColumn("_taken", taken).where("not _taken and not _undo").drop("_kind", "_undo", "_level", "_taken")


def conflicts(events: DataFrame, group: str) -> DataFrame:
    """``(group, facilities, conflict, order_ok)``: several facilities in one admission, and whether discharge follows admission."""
    return events.groupBy(group).agg(
        F.count_distinct("facility").alias("facilities"),
        F.coalesce(F.max(F.when(F.col("event_type") == "A03", F.col("ts"))) >= F.min(F.when(F.col("event_type") == "A01", F.col("ts"))), F.lit(True)).alias("order_ok"),
    ).withColumn("conflict", F.col("facilities") > 1)


def stays(events: DataFrame, member: str, ts: str, tie: str, admit: str = "A01", discharge: str = "A03", transfer_hours: int = 24, open_days: int = 30, now=None) -> DataFrame:
    """``(member, stay, admit_ts, discharge_ts, n_legs, state)``: admissions with the next discharge; legs that begin within ``transfer_hours`` of a
    discharge are one stay; open stays older than ``open_days`` are stale."""
    w = Window.partitionBy(member).orderBy(ts, tie)
    moves = events.where(F.col("event_type").isin(admit, discharge))
    nxt = moves.withColumn("_next", F.lead(F.struct("event_type", ts)).over(w)).where(F.col("event_type") == admit)
    legs = nxt.select(member, F.col(ts).alias("a"), tie, F.when(F.col("_next.event_type") == discharge, F.col(f"_next.{ts}")).alias("d"))
    v = Window.partitionBy(member).orderBy("a", tie)
    gap = F.unix_timestamp("a") - F.unix_timestamp(F.lag("d").over(v))
    new = F.when(F.coalesce(gap <= transfer_hours * 3600, F.lit(False)), 0).otherwise(1)
    legs = legs.withColumn("stay", F.sum(new).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    out = legs.groupBy(member, "stay").agg(F.min("a").alias("admit_ts"), F.max_by("d", F.struct("a", tie)).alias("discharge_ts"), F.count("*").alias("n_legs"))
    today = now if now is not None else F.current_timestamp()
    state = F.when(F.col("discharge_ts").isNotNull(), "closed").when(F.datediff(today, "admit_ts") > open_days, "stale").otherwise("open")
    return out.withColumn("stay", F.col("stay").cast("int")).withColumn("state", state)


def readmissions(closed: DataFrame, member: str, days: tuple[int, ...] = (7, 15, 30), end=None) -> DataFrame:
    """``closed`` stays with the days until the member's next admission, a flag for each window, and whether the longest window is complete."""
    nxt = F.lead("admit_ts").over(Window.partitionBy(member).orderBy("admit_ts", "discharge_ts"))
    out = closed.withColumn("days_to_next", F.datediff(nxt, "discharge_ts"))
    for d in days:
        out = out.withColumn(f"readmit_{d}", F.coalesce(F.col("days_to_next").between(0, d), F.lit(False)))
    last = end if end is not None else F.current_timestamp()
    return out.withColumn("window_complete", F.col("readmit_%d" % max(days)) | (F.datediff(last, "discharge_ts") >= max(days)))
