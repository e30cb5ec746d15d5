"""Writers.  Spark's committers make each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import integer_text
from .records import LABEL_COLUMNS


def write_labels(df: DataFrame, path: str) -> None:
    """A label table as CSV: schema columns first, pages and diagrams as whole numbers."""
    ordered = [c for c in LABEL_COLUMNS if c in df.columns] + [c for c in df.columns if c not in LABEL_COLUMNS]
    whole = {"source_page", "source_diagram"}
    df.select(*[integer_text(c).alias(c) if c in whole else c for c in ordered]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order; sorted by ranges, so that no single task writes all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_by_book(df: DataFrame, path: str, book: str = "book") -> None:
    """Replaces the folders of the books that ``df`` holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(book).parquet(path)


def write_gated(df: DataFrame, path: str) -> None:
    """PGN texts in a folder for each verdict, in page order within files."""
    df.select("verdict", "page", "diagram", F.col("pgn").alias("value")).repartitionByRange("verdict", "page").sortWithinPartitions("verdict", "page", "diagram").select("verdict", "value").write.mode("overwrite").partitionBy("verdict").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


# The columns of census and rejection files.
CENSUS_COLUMNS = ["pdf", "page", "index", "source", "side_pt", "native_width", "native_height", "trimmed", "detector_score", "texture", "x0", "y0", "x1", "y1"]
REJECTION_COLUMNS = ["pdf", "page", "reason", "score", "checker", "side_pt", "x0", "y0", "x1", "y1"]


def _write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_splits(df: DataFrame, path: str) -> None:
    """(filename, split) as CSV in the order of the names."""
    _write_csv(df, path, ["filename", "split"], ["filename"])


def write_census(df: DataFrame, path: str) -> None:
    """Candidates as CSV, one row each."""
    _write_csv(df, path, CENSUS_COLUMNS, ["pdf", "page", "index"])


def write_rejections(df: DataFrame, path: str) -> None:
    """Candidates that were turned down as CSV, one row each with its reason."""
    _write_csv(df, path, REJECTION_COLUMNS, ["pdf", "page", "reason", "y0", "x0"])


def write_annotations(df: DataFrame, path: str, book: str = "book") -> None:
    """Annotations as JSON, a folder for each book; books that ``df`` doesn't hold keep theirs."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(book).json(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """Matches in the second version of their artefact: a row for each book, its diagrams with winner and candidates."""
    diagram = F.struct(*[c for c in matches.columns if c != "book"])
    per_book = matches.groupBy("book").agg(F.array_sort(F.collect_list(diagram)).alias("diagrams"))
    per_book.select(F.lit(2).alias("version"), "book", "diagrams").write.mode("overwrite").json(path)


def backup(spark: SparkSession, path: str, stamp: str) -> str:
    """A copy of a table's files beside it, under its name and the stamp; an error if that is taken."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{stamp}.bak")
    files, conf = here.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()
    if files.exists(there):
        raise FileExistsError(str(there))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, here, files, there, False, conf)
    return str(there)


def migrate_ledger(spark: SparkSession, old: str, new: str, fingerprint: str) -> int:
    """Moves a ledger of placements from its JSON form to Parquet, once; how many rows it brought.

    The JSON lines have fingerprint, placement, count and games.  Nothing happens if the new
    ledger is there, the old one isn't, or the old one is of another database.  The old one is
    then renamed.
    """
    conf = spark._jsc.hadoopConfiguration()
    here, there = spark._jvm.org.apache.hadoop.fs.Path(old), spark._jvm.org.apache.hadoop.fs.Path(new)
    files = here.getFileSystem(conf)
    if files.exists(there) or not files.exists(here):
        return 0
    rows = spark.read.schema("fingerprint string, placement string, count int, games array<map<string,string>>").json(old)
    if not rows.where(~F.coalesce(F.col("fingerprint") == fingerprint, F.lit(True))).isEmpty():
        return 0
    last = rows.where("placement is not null").groupBy("placement").agg(F.max_by(F.struct("count", "games"), "count").alias("r")).select("placement", "r.count", "r.games")
    last.write.mode("error").parquet(new)
    files.rename(here, spark._jvm.org.apache.hadoop.fs.Path(f"{old.rstrip('/')}.migrated"))
    return spark.read.parquet(new).count()


def write_hash_index(rows: DataFrame, path: str, dpi: int, hash_size: int) -> None:
    """Adds books to an index of hashes: a book that was indexed before is replaced, the others stay.

    An index made with another dpi or hash size is an error: its hashes can't be compared.
    """
    spark, made = rows.sparkSession, rows.withColumns({"dpi": F.lit(dpi), "hash_size": F.lit(hash_size)})
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        other = spark.read.parquet(path).where((F.col("dpi") != dpi) | (F.col("hash_size") != hash_size))
        if not other.isEmpty():
            raise ValueError("the index was made with another dpi or hash size")
    write_by_book(made, path, "source_pdf")
