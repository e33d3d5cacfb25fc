"""Registered queries: name -> (Spark query, SQL giving the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowharvest.session import configure
from rowharvest.sources.nodes import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows need much computation: given to all cores if it has too few splits for them."""
    return spread(table(spark, sf_dir, name))


def load() -> None:
    from rowharvest.queries import derived, page_tables, plan_tables, record_tables, streams, value_tables  # noqa: F401
