"""Registry of queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its equivalent over the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One driver table, with the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small file dealt over the cluster, where each of them becomes much work.

    A file of few bytes is one task, however many rows it holds.
    """
    return rows.repartition(_spread_parts(rows))


def spread_by_values(rows: DataFrame) -> DataFrame:
    """The same by a hash of all columns: rows of a large file are not sorted first, and equal rows lie together."""
    return rows.repartition(_spread_parts(rows), *rows.columns)


def _spread_parts(rows: DataFrame) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, 2) * 4
