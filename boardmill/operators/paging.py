"""Pages of a large ordered table: any page reads the ranges that hold it, not the rows before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import fresh_folder


class OrderedTable:
    """A table dealt to ranges of an order, written to a folder for each range, with the rows of every range counted.

    Without ``ranges`` Spark chooses how many by their bytes.  The order must be total for pages to be
    the same on every call.  Equal and null values of the order's first
    columns may stand in one range, so one that many rows share should be followed by others.
    """

    def __init__(self, df: DataFrame, order: list[Column | str], path: str | None = None, ranges: int | None = None):
        spark = df.sparkSession
        self.order, self.columns = order, df.columns
        self.path = path or fresh_folder(spark, "ordered")
        dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
        ranged = dealt.sortWithinPartitions(*order).select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("part"))
        ranged.write.partitionBy("part").parquet(self.path)
        self.table = spark.read.schema(ranged.schema).parquet(self.path)
        counts = self.table.groupBy("part").count().orderBy("part").collect()  # one row for each range
        self.ranges: list[tuple[int, int, int]] = []  # (range, rows before it, rows)
        self.total = 0
        for r in counts:
            self.ranges.append((r.part, self.total, r["count"]))
            self.total += r["count"]

    def rows(self, offset: int, size: int) -> DataFrame:
        """``size`` rows from ``offset`` on, in order; the plan reads only the ranges that hold them."""
        offset, end = max(0, offset), max(0, offset) + max(0, size)
        held = [(p, before) for p, before, n in self.ranges if before < end and offset < before + n]
        some = self.table.where(F.col("part").isin([p for p, _ in held])).select("row.*") if held else self.table.limit(0).select("row.*")
        return some.orderBy(*self.order).offset(offset - (held[0][1] if held else 0)).limit(size)

    def page(self, number: int, size: int) -> DataFrame:
        """A page by its number from 0; one past the end is the last, a negative one the first."""
        return self.rows(min(max(number, 0), max(0, -(-self.total // size) - 1)) * size, size)
