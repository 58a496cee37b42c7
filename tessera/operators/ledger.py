"""Reports over append-only ledgers of runs, steps, versions and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; every column of the tie-break belongs to ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_state(events: DataFrame) -> DataFrame:
    """``(batch_id, kind, status, started, finished)`` from run events ``(batch_id, kind, status, at)``."""
    return events.groupBy("batch_id", "kind").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("started"), F.max(F.when(F.col("status").isin("completed", "failed"), F.col("at"))).alias("finished"))


def lineage(manifest: DataFrame, runs: DataFrame, approvals: DataFrame) -> DataFrame:
    """One row a batch: its file, its runs' states and the first approval of each gate; a later pass fills what an earlier one lacked."""
    state = runs.groupBy("batch_id").pivot("kind", ["bronze", "silver"]).agg(F.first("status"))
    gates = first_approvals(approvals).groupBy("batch_id").pivot("gate", ["G1", "G2"]).agg(F.first("approver"))
    out = manifest.join(state, "batch_id", "left").join(gates, "batch_id", "left")
    return out.withColumn("complete", F.coalesce((F.col("bronze") == "completed") & (F.col("silver") == "completed"), F.lit(False)))


def first_approvals(approvals: DataFrame) -> DataFrame:
    return approvals.groupBy("batch_id", "gate").agg(F.min_by("approver", F.struct("at", "approver")).alias("approver"), F.min("at").alias("at"))


def superseded(versions: DataFrame) -> DataFrame:
    """Versions ``(feed, version, status)`` with at most one approved a feed, the highest; and the next number."""
    w = Window.partitionBy("feed")
    top = F.max(F.when(F.col("status") == "approved", F.col("version"))).over(w)
    status = F.when((F.col("status") == "approved") & (F.col("version") < top), "superseded").otherwise(F.col("status"))
    return versions.withColumn("effective_status", status).withColumn("next_version", F.max("version").over(w) + 1)


def worklist(items: DataFrame, approvals: DataFrame, k: int = 8) -> DataFrame:
    """Items ``(item, gate, waiting_since)`` that no approval has closed: the k newest of each gate, with the gate's count."""
    left = items.join(approvals.select("item", "gate").distinct(), ["item", "gate"], "left_anti")
    w = Window.partitionBy("gate")
    out = left.withColumn("waiting", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("waiting_since").desc(), "item")))
    return out.where(F.col("rank") <= k)


def attention(steps: DataFrame, limit: int = 20) -> DataFrame:
    """Newest step of each batch that failed or is in flight and is no gate; failures first, then newest."""
    now = latest_by(steps, ["batch_id"], ["at", "step"]).where("not is_gate and status in ('failed', 'running')")
    return now.orderBy((F.col("status") != "failed").cast("int"), F.col("at").desc(), "batch_id").limit(limit)


def step_progress(declared: DataFrame, steps: DataFrame) -> DataFrame:
    """Every declared step of every batch at its newest generation; steps not begun are ``not_reached``."""
    newest = latest_by(steps, ["batch_id", "step"], ["generation"]).select("batch_id", "step", "generation", "status")
    every = steps.select("batch_id").distinct().join(F.broadcast(declared.select("step", "position")))
    out = every.join(newest, ["batch_id", "step"], "left")
    return out.select("batch_id", "position", "step", F.coalesce("generation", F.lit(0)).alias("generation"), F.coalesce("status", F.lit("not_reached")).alias("status"))


def sorted_by(rows: DataFrame, key: Column, descending: bool = False, tie: str = "row_number") -> DataFrame:
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)


def illegal_transitions(history: DataFrame, legal: DataFrame, key: str, at: list[str]) -> DataFrame:
    """``(key, was, status)`` steps from one status to the next that ``legal`` (was, status) does not hold; the first status of a key is legal."""
    moves = history.withColumn("was", F.lag("status").over(Window.partitionBy(key).orderBy(*at))).where("was is not null and was <> status")
    return moves.select(key, "was", "status").join(legal, ["was", "status"], "left_anti").select(key, "was", "status")
