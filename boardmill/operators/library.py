"""A library of archives in one job: what can't be read is a row of the report, the others go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.archive import SPLIT_BYTES, scan_files
from ..sources.staging import staged


def library_batch(files: DataFrame, done: DataFrame, book: Column, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(games, report) of a library: games of the books that were read whole, and what became of each book.

    ``files`` are (path, length), as ``archive_files`` lists them, ``book`` says which book a path
    belongs to, ``done`` has the books (column book) that aren't run again.  The report is (book, status, files, games, error): ok,
    failed (with the first error; none of its games is given) or skipped.  A book of empty files is ok with 0 games.  The
    scan runs when this is called and is written to the shared folder, so that games and report tell of the same reading.
    """
    named = files.withColumn("book", book.cast("string"))
    known = done.select(F.col("book").cast("string")).distinct()
    to_run = named.join(known, "book", "left_anti")
    read = staged(scan_files(to_run.select("path", "length"), split_bytes, keep_errors=True), "library").withColumn("book", book.cast("string"))
    found = read.groupBy("book").agg(F.count_if(F.col("error").isNull()).alias("_games"), F.min("error").alias("error"))
    report = named.groupBy("book").agg(F.count(F.lit(1)).alias("files")).join(found, "book", "left").join(known.withColumn("_done", F.lit(True)), "book", "left")
    status = F.when(F.col("_done"), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    games = F.when(status == "ok", F.coalesce("_games", F.lit(0))).otherwise(0).cast("long")
    report = report.select("book", status.alias("status"), "files", games.alias("games"), "error")
    return read.join(report.where("status = 'ok'").select("book"), "book", "left_semi").drop("error"), report


def census_totals(report: DataFrame) -> DataFrame:
    """One row: books by status and games; failed books take nothing from the totals of the others."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")]
    return report.agg(F.count(F.lit(1)).alias("books"), *by, F.coalesce(F.sum("games"), F.lit(0)).alias("games"))
