"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from muster.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]
Table = Callable[[str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Table], DataFrame]], Callable[[Table], DataFrame]]:
    """Register a function from a table reader to a result, with the SQL for the same result if there is one."""
    def register(function: Callable[[Table], DataFrame]) -> Callable[[Table], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_settings(spark)
            return function(Tables(spark, folder))

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


class Tables:
    """Reads the tables of one folder by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
