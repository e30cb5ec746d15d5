"""Row changes as plans: each returns the table after the change, to be written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_columns_in_order(df: DataFrame, schema: list[str]) -> DataFrame:
    """The schema's columns, '' where one is missing, then the others in the order they have."""
    named = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in schema]
    return df.select(*named, *[c for c in df.columns if c not in schema])


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, patch: DataFrame, key: list[str], only_where: Column | None = None) -> DataFrame:
    """Rows with the patch's non-null values, where ``only_where`` holds; columns that only the patch has are added.

    The patch has one row for each key.
    """
    fields = [c for c in patch.columns if c not in key]
    renamed = patch.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = table.join(renamed, key, "left")
    may = F.col("_hit").isNotNull() if only_where is None else F.col("_hit").isNotNull() & F.coalesce(only_where, F.lit(False))
    kept = [F.when(may, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns]
    added = [F.when(may, F.col(f"_new_{c}")).alias(c) for c in fields if c not in table.columns]
    return joined.select(*kept, *added)


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def move(source: DataFrame, destination: DataFrame, keys: DataFrame, key: list[str], extra: dict[str, Column] | None = None, drop: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, destination) after rows moved; write the destination first, so that a failure loses nothing."""
    moved = source.join(keys.select(*key).distinct(), key, "left_semi").drop(*(drop or []))
    for name, value in (extra or {}).items():
        moved = moved.withColumn(name, value)
    return delete(source, keys, key), insert(destination, moved)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` in place of the table's rows with the same keys."""
    return insert(delete(table, rows, key), rows)


def transaction(table: DataFrame, *steps) -> DataFrame:
    """Several changes as one plan and so one write; an error in any changes nothing."""
    return reduce(lambda df, step: step(df), steps, table)


def keep_first(df: DataFrame, group: list[Column | str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def replace_partition(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in place of all rows of the partitions (books) that they belong to."""
    return upsert(table, rows, [key])


def page_of(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """One page of an ordered table; a page past the end is the last one."""
    total = df.count()
    last = max(0, -(-total // size) - 1)
    return df.orderBy(*order).offset(min(max(page, 0), last) * size).limit(size)
