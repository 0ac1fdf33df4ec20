"""Registered queries: a name, a function of (spark, sf_dir), and SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(tables) under a name; tables(t) reads one table of the data folder, tables.spark is the session."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def tables(t: str) -> DataFrame:
                return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{t}.parquet")

            tables.spark = spark
            return f(tables)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
