"""Registered queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    """A small vocabulary as a table."""
    return spark.createDataFrame(values, schema)


def ordered_distinct(column: str) -> str:
    """DuckDB: the distinct entries of a list in the order of their first place."""
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"
