"""Registration of queries: a plan over the driver's tables and, where SQL can express it, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a table reader t(name) under its name."""

    def add(plan):
        key = name or plan.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return plan

    return add
