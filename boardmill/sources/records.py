"""Readers: record-aligned game archives, tolerant CSV, JSON lines under three policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_cell, surname
from ..operators.merges import kept_headers

# The columns of a label table; the first two are required.
LABEL_COLUMNS = ["filename", "fen", "side_to_move", "source_pdf", "source_page", "source_diagram", "detection_source", "created_at", "corrected_by", "illegal_ok"]


def read_games(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, headers, setup_fen, movetext, white, black) of each record of game archives.

    Splits realign on the record separator, so files are read in parallel whatever their size.
    white and black are folded surnames.
    """
    raw = spark.read.option("lineSep", "\n[Event ").text(paths).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r", "").alias("_r"))
    first = F.regexp_replace(F.col("_r"), "^﻿?\\s*\\[Event ", "")
    record = F.concat(F.lit("[Event "), first)
    raw = raw.where(F.trim(F.regexp_replace("_r", "﻿", "")) != "").select("file", record.alias("_r"))
    return parsed_records(raw, ["file"])


def parsed_records(raw: DataFrame, keep: list[str], record: str = "_r") -> DataFrame:
    """(keep, headers, setup_fen, movetext, white, black) of rows with the text of one record each; a null text gives nulls."""
    parts = raw.withColumn("_head", F.regexp_extract(record, r"^((?:\s*\[[^\n]*\n?)+)", 1))
    tags = lambda k: F.regexp_extract_all("_head", F.lit(r'\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]'), F.lit(k))
    parts = parts.withColumn("_names", tags(1)).withColumn("_values", tags(2))
    plain = lambda v: F.when(F.contains(v, F.lit("\\")), F.regexp_replace(v, r"\\(.)", "$1")).otherwise(v)
    entries = F.zip_with("_names", "_values", lambda n, v: F.struct(n.alias("key"), plain(v).alias("value")))
    firsts = F.filter(entries, lambda e, k: F.array_position(F.col("_names"), e["key"]) == k + 1)
    parts = parts.withColumn("_all", F.map_from_entries(firsts))
    moves = F.regexp_replace(F.substr(record, F.length("_head") + 1), r"^\s+|\s+$", "")
    player = lambda h: F.when(F.col(record).isNotNull(), surname(F.coalesce(F.try_element_at("_all", F.lit(h)), F.lit(""))))
    return parts.select(*keep, kept_headers(F.col("_all")).alias("headers"), F.try_element_at("_all", F.lit("FEN")).alias("setup_fen"), moves.alias("movetext"), player("White").alias("white"), player("Black").alias("black"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pgn") -> DataFrame:
    """(file_id, path, length) of a folder's files in the order of their lower-cased names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.withColumn("file_id", F.row_number().over(Window.orderBy(name)) - 1).select("file_id", "path", "length")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: name:size of all files, sorted; times don't count."""
    line = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.col("length").cast("string"))
    return files.agg(F.array_join(F.array_sort(F.collect_list(line)), "|").alias("fingerprint"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label table: all text, cleaned, missing columns '', extra ones kept; without filename or fen an error."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = [c.strip() for c in raw.columns]
    if lacking := {"filename", "fen"} - set(names):
        raise ValueError(f"no column {', '.join(sorted(lacking))} in {path}")
    raw = raw.toDF(*names)
    known = [clean_cell(c).alias(c) if c in names else F.lit("").alias(c) for c in LABEL_COLUMNS]
    return raw.select(*known, *[clean_cell(c).alias(c) for c in names if c not in LABEL_COLUMNS])


def schema_version(columns: list[str]) -> int:
    """2 if a label table has all columns, else 1."""
    return 2 if set(LABEL_COLUMNS) <= set(columns) else 1


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(filename, split); any other split than train, val and test is an error when read."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    good = F.col("split").isin("train", "val", "test")
    return rows.select("filename", F.when(good, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("split "), F.coalesce("split", F.lit("null"))))).alias("split"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, policy: str = "fail") -> DataFrame:
    """JSON lines; blank and // lines are skipped.

    ``policy`` for a malformed line: fail, skip, or torn (in each file, that line and all after it
    are left out, as after a broken write).
    """
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if policy == "torn":
        # one file is one unfinished artefact of one document, so it fits a row
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\n")).alias("_n", "value"))
    else:
        whole = spark.read.text(path).select("value")
    lines = whole.where((F.trim("value") != "") & ~F.ltrim(F.col("value")).startswith("//"))
    if policy == "fail":
        return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    lines = lines.withColumn("_bad", F.try_parse_json("value").isNull())
    if policy == "torn":
        first_bad = F.min(F.when(F.col("_bad"), F.col("_n"))).over(Window.partitionBy("_file"))
        lines = lines.withColumn("_stop", first_bad).where("_stop is null or _n < _stop")
    return lines.where(~F.col("_bad")).select(F.from_json("value", kind).alias("r")).select("r.*")
