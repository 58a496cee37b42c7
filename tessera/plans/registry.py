"""Every query of the library, by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import care_queries, core_queries, ops_queries, rule_queries

ALL = {**core_queries.QUERIES, **rule_queries.QUERIES, **care_queries.QUERIES, **ops_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of a promoted batch."""
    return core_queries.promotion_balance(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
