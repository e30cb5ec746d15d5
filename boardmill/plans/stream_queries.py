"""Incremental scans, run to their end so that they can be compared with one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import fresh_folder
from ..streaming import export, incremental, progress
from .catalogue import Tables, query


@query(
    "event_type string, n bigint, total double",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total
        FROM events GROUP BY event_type""",
)
def resume_scan(t: Tables) -> DataFrame:
    """A stream of the files at hand into two sinks, asked twice: the second call finds nothing new."""
    folder = fresh_folder(t.spark, "scan")
    schema = t("events").schema
    stream = incremental.scan(t.spark, f"{t.folder}/events.parquet*", schema)
    sinks = [incremental.batch_sink(f"{folder}/rows"), incremental.batch_sink(f"{folder}/progress")]
    for _ in range(2):
        incremental.run_available(stream, sinks, f"{folder}/{incremental.parameters_key({'files': 5})}")
    rows = t.spark.read.schema(schema).parquet(f"{folder}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query(
    "book string, n bigint, resume_from bigint",
    """SELECT event_type AS book, count(*) FILTER (value > 50) AS n, max(event_id % 100) + 1 AS resume_from
        FROM events GROUP BY event_type""",
)
def resume_export(t: Tables) -> DataFrame:
    """An export that is asked twice: rows of finished batches, and the page from which each book would go on."""
    folder, schema = fresh_folder(t.spark, "export"), t("events").schema
    parameters = {"least": 50}
    for _ in range(2):
        log = export.ExportLog(t.spark, f"{folder}/out", parameters, "model")
        log.open()
        pages = incremental.scan(t.spark, f"{t.folder}/events.parquet*", schema).withColumn("page", F.col("event_id") % 100)
        incremental.run_available(pages, [log.sink("event_type", "page", lambda df: df.where("value > 50").select("event_type", "event_id"))], f"{folder}/{incremental.parameters_key(parameters, 'model')}")
    counts = log.rows("event_type string, event_id long").groupBy(F.col("event_type").alias("book")).agg(F.count(F.lit(1)).alias("n"))
    return log.resume_from().join(counts, "book", "left").select("book", F.coalesce("n", F.lit(0)).alias("n"), "resume_from")


@query("counted bigint, written bigint, total double", "SELECT count(*) AS counted, count(*) AS written, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events")
def scan_counters(t: Tables) -> DataFrame:
    """Counters of a running scan beside what it wrote."""
    folder, schema = fresh_folder(t.spark, "counted"), t("events").schema
    counted = progress.Progress("pages", F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    t.spark.streams.addListener(counted)
    try:
        incremental.run_available(counted.watch(incremental.scan(t.spark, f"{t.folder}/events.parquet*", schema)), [incremental.batch_sink(f"{folder}/rows")], f"{folder}/state")
        batches = counted.batches().values()
    finally:
        t.spark.streams.removeListener(counted)
    rows = t.spark.read.schema(schema).parquet(f"{folder}/rows").agg(F.count(F.lit(1)).alias("written"))
    return rows.select(F.lit(sum(b["n"] for b in batches)).alias("counted"), "written", F.lit(float(sum(b["total"] or 0 for b in batches))).alias("total"))
