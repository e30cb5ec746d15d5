"""Bounded incremental processing: scans that resume after the last finished batch of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def parameters_key(parameters: dict[str, object], model: str = "") -> str:
    """A folder name for a scan's checkpoint: scans with other parameters don't resume each other."""
    text = "&".join(f"{k}={parameters[k]}" for k in sorted(parameters)) + (f"&model={model}" if model else "")
    return "".join(c if c.isalnum() or c in "=._-" else "_" for c in text)


def compatible(stored: dict[str, object], wanted: dict[str, object], stored_model: str = "", wanted_model: str = "") -> bool:
    """Whether a partial result may be continued; the model counts only if both sides name one."""
    return stored == wanted and (not stored_model or not wanted_model or stored_model == wanted_model)


def scan(spark: SparkSession, folder: str, schema: T.StructType, files_each: int = 5) -> DataFrame:
    """New Parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def run_available(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Runs what is there now, batch by batch, into all sinks; a later call goes on after the last finished batch.

    A batch that failed half-way is given again with the same number, so sinks write by it.  A
    single sink gets the batch as it is, in one pass; several share a kept copy.
    """

    def feed(batch: DataFrame, number: int) -> None:
        if len(sinks) == 1:
            sinks[0](batch, number)
            return
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder, so that a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def watermark(progress: DataFrame, book: str = "book", page: str = "page") -> DataFrame:
    """(book, resume_from): the page after the last finished one, by progress rows, so pages without diagrams count."""
    return progress.groupBy(book).agg((F.max(page) + 1).alias("resume_from"))
