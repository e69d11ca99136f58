"""Named queries over the given tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.operators.spread import spread_small

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``views`` are put before its SQL as common table expressions."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return function

    return register


def with_views(sql: str, views: tuple[str, ...]) -> str:
    if not views:
        return sql.strip()
    recursive = "RECURSIVE " if any("UNION ALL" in VIEWS[v] and f"FROM {v}" in VIEWS[v] for v in views) else ""
    bodies = ",\n".join(f"{v} AS (\n{VIEWS[v].strip()}\n)" for v in views)
    return f"WITH {recursive}{bodies}\n{sql.strip()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table for work that is heavy per row."""
    return spread_small(table(spark, sf_dir, name).select(*columns))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles whose last bits depend on the order of summation or interpolation."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql_rounded(sql: str, digits: int, *columns: str) -> str:
    changed = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({changed}) FROM (\n{sql.strip()}\n)"
