"""Registering queries: a function over tables, its result's columns and types, and the SQL it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_SQL_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(columns: str, sql: str | None = None) -> Callable:
    """Registers a function under its name; both sides are cast to the columns' types."""
    fields = [c.split() for c in columns.split(", ")]

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder)).select(*[F.col(n).cast(t).alias(n) for n, t in fields])

        name = function.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = f"SELECT {', '.join(f'CAST({n} AS {_SQL_TYPE[t]}) AS {n}' for n, t in fields)} FROM ({sql}) AS q"
        return function

    return register
