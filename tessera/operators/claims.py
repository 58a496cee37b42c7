"""Claims: adjustment types, final action, versions, settings, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.change import latest


def adjustment_type(code: Column) -> Column:
    """ORIGINAL, CANCELLATION or ADJUSTMENT from the three vocabularies; null for any other code."""
    c = F.lower(F.trim(code))
    return F.when(c.isin("0", "original"), "ORIGINAL").when(c.isin("1", "void", "reversal", "cancellation"), "CANCELLATION").when(c.isin("2", "replacement", "prior", "adjustment"), "ADJUSTMENT")


def final_action(claims: DataFrame, key: list[str], order: str) -> DataFrame:
    """Claims that stand: each cancellation takes out one original or adjustment of its key, in order; both go."""
    side = F.col("adjustment") == "CANCELLATION"
    n = F.row_number().over(Window.partitionBy(*key, side).orderBy(order))
    rows = claims.withColumn("_n", n)
    gone = rows.where("adjustment = 'CANCELLATION'").select(*key, "_n")
    return rows.where("adjustment <> 'CANCELLATION'").join(gone, [*key, "_n"], "left_anti").drop("_n")


def current_version(claims: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest version of each claim unless that one is a void."""
    return latest(claims, key, F.col(version).desc()).where("adjustment <> 'CANCELLATION'").drop("collapsed")


def net_payment(claims: DataFrame, by: list[str], amount: str) -> DataFrame:
    """``(by, net, gross, reversals, reversal_rate)``: cancellations count negative."""
    void = F.col("adjustment") == "CANCELLATION"
    value = F.col(amount).cast("decimal(18,4)")
    out = claims.groupBy(*by).agg(
        F.sum(F.when(void, -F.abs(value)).otherwise(value)).alias("net"), F.sum(F.when(~void, value).otherwise(0)).alias("gross"),
        F.count_if(void).alias("reversals"), F.count("*").alias("n"),
    )
    return out.withColumn("reversal_rate", F.round(F.col("reversals") / F.col("n"), 6)).drop("n")


def care_setting(headers: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Each claim's setting from its type, bill type, and its lines' revenue codes and places of service."""
    some = lines.groupBy(key).agg(F.bool_or(F.col("revenue_code").rlike("^045")).alias("er"), F.bool_or(F.col("place_of_service") == "23").alias("er_pos"), F.bool_or(F.col("place_of_service").isin("11", "02")).alias("office"))
    j = headers.join(some, key, "left")
    setting = (
        F.when(F.col("bill_type").startswith("11"), "inpatient").when(F.col("bill_type").startswith("21"), "skilled_nursing").when(F.coalesce("er", "er_pos", F.lit(False)) | F.coalesce("er_pos", F.lit(False)), "emergency")
        .when(F.col("claim_type") == "pharmacy", "pharmacy").when(F.col("bill_type").startswith("13"), "outpatient").when(F.coalesce("office", F.lit(False)), "office").otherwise("other")
    )
    return j.withColumn("setting", setting).drop("er", "er_pos", "office")


def amounts_wide(amounts: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """One row a claim, one column a category; the categories are given, so nothing is scanned to find them."""
    return amounts.groupBy(key).pivot("category", categories).agg(F.sum(F.col("amount").cast("decimal(18,4)")))
