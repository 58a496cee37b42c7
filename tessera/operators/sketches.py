"""Profiles that add up: what a batch contributes is kept as one small row a column, and a feed's profile is made of these alone.

Sums and extremes merge exactly. Distinct values, frequent values and quantiles are sketches of fixed size, whose errors do not grow with the rows: HyperLogLog (standard error
1.04 / sqrt(2 ** LG_K)), frequent items (a value's count is short by at most 1 / (0.75 * ITEMS) of the rows, nothing more frequent than that is missed) and KLL (rank
error about 1.65 % of the rows, at 99 % confidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import finished, looked_at, measures, unpivoted

#: Registers of the distinct counter (log 2), slots of the frequent values, and the size of the quantile sketch.
LG_K, ITEMS, KLL = 12, 1024, 200
#: Sums; then extremes.
SUMS = ("row_count", "null_count", "ints", "decimals", "dates", "timestamps", "bools", "codes", "sentinel_count")
LEAST, MOST = ("low", "from"), ("high", "to")


def profile_state(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column of a batch: ``measures`` and sketches. Cells are aggregated where they are read; only rows of this size are shuffled.

    ``rows`` as in ``column_facts``. Protected columns have no frequent values and no quantiles. An empty batch gives no row.
    """
    return looked_at(unpivoted(rows, columns)).groupBy("position", "column").agg(
        *measures(F.lit(1).cast("long")), F.hll_sketch_agg(F.when(F.col("some"), F.col("value")), LG_K).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(if(some and not phi, value, null), {ITEMS})").alias("frequent"), F.kll_sketch_agg_double(F.when(~F.col("phi"), F.col("number")), KLL).alias("quantiles"),
    )


def merged(states: DataFrame) -> DataFrame:
    """States of any batches as one of the same shape, in whatever order and grouping they come."""
    return states.groupBy("column").agg(
        F.min("position").alias("position"), *[F.sum(c).alias(c) for c in SUMS], *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST],
        F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(frequent, {ITEMS})").alias("frequent"), F.kll_merge_agg_double("quantiles", KLL).alias("quantiles"),
    )


def told(state: DataFrame, k: int = 10) -> DataFrame:
    """Facts as ``column_facts`` gives them, with ``distinct_count`` estimated, and ``top`` (value, count), ``median`` and the ``error`` of distinct counts (three standard errors)."""
    estimate = F.least(F.hll_sketch_estimate("distinct"), F.col("row_count") - F.col("null_count"))
    facts = finished(state.withColumn("distinct_count", estimate))
    top = F.transform(F.expr(f"approx_top_k_estimate(frequent, {k})"), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
    has = F.kll_sketch_get_n_double("quantiles") > 0
    more = state.select("column", F.filter(top, lambda x: x["value"].isNotNull()).alias("top"), F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"), F.lit(3 * 1.04 / 2 ** (LG_K / 2)).alias("error"))
    return facts.join(more, "column")


def recorded(rows: DataFrame, path: str, batch_id: str, columns: list[str] | None = None) -> None:
    """Add or replace a batch's states in the table at ``path``; no other batch's is read or written."""
    state = profile_state(rows, columns).withColumn("batch_id", F.lit(batch_id))
    state.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
