"""Readers of the JSON and CSV artefacts that scans leave: annotations, indexes, queues, hash rows, matches, censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "struct<move_number:int,side_to_move:string,lichess_link:boolean,headers:map<string,string>,filled_from:string,chosen_game:string,filled_rule:string,filled_fields:array<string>,confirmed_from:string>"
INDEX_ENTRY = "struct<page_index:int,diagram_index:int,placement:string,side_to_move:string,side_to_move_source:string,min_confidence:double,is_legal:boolean,image_path:string,caption:string>"
QUEUE_ITEM = "struct<page_index:int,diagram_index:int,fen:string,side_to_move:string,min_confidence:double,mean_entropy:double,priority:double,reasons:array<string>,uncertain_squares:array<int>,status:string>"
CANDIDATE = "struct<move_number:int,side:string,headers:map<string,string>,verified:boolean>"
MATCH = f"struct<page_index:int,diagram_index:int,move_number:int,side_to_move:string,headers:map<string,string>,games_matched:int,game_label:string,candidates:array<{CANDIDATE}>>"
CENSUS = "pdf string, page int, `index` int, source string, side_pt double, native_width int, native_height int, trimmed boolean, detector_score double, texture double, x0 double, y0 double, x1 double, y1 double"
REJECTION = "pdf string, page int, reason string, score double, checker double, side_pt double, x0 double, y0 double, x1 double, y1 double"


def _documents(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """One row for each JSON file, r null where it is broken; a file is one book's artefact."""
    raw = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return raw.select("file", F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", kind)).alias("r"))


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(book, page, diagram, annotation fields): keys are 'page.diagram'; broken files give no row."""
    rows = _documents(spark, paths, f"struct<source_name:string,diagrams:map<string,{ANNOTATION}>>")
    rows = rows.select(F.coalesce("r.source_name", "file").alias("book"), F.explode("r.diagrams").alias("at", "a"))
    at = F.split("at", r"\.")
    return rows.select("book", at[0].try_cast("int").alias("page"), F.get(at, F.lit(1)).try_cast("int").alias("diagram"), "a.*").where("page is not null and diagram is not null")


def read_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(book, last_page_done, complete, entry fields) of diagram indexes."""
    rows = _documents(spark, paths, f"struct<source_pdf:string,last_page_done:int,complete:boolean,entries:array<{INDEX_ENTRY}>>")
    return rows.select(F.col("r.source_pdf").alias("book"), "r.last_page_done", "r.complete", F.inline("r.entries"))


def read_queue(spark: SparkSession, paths: str | list[str], version: int = 1) -> DataFrame:
    """Items of review queues of this version; others and broken files give none."""
    rows = _documents(spark, paths, f"struct<version:int,pdf_path:string,items:array<{QUEUE_ITEM}>>").where(F.col("r.version") == version)
    return rows.select(F.col("r.pdf_path").alias("book"), F.inline("r.items"))


def read_matches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(book, match fields) of both versions; the first has no candidates, which is an empty array."""
    rows = _documents(spark, paths, f"struct<books:map<string,array<{MATCH}>>>").select(F.explode("r.books").alias("book", "m")).select("book", F.inline("m"))
    return rows.withColumn("candidates", F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>")))


def read_hash_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_pdf, source_page, source_diagram, detection_source, words, readable): hash text as four 64-bit words.

    The header line is left out; rows that can't be read stay with readable false, to be counted.
    """
    lines = spark.read.text(paths).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", "kind string, source_pdf string, source_page int, source_diagram int, detection_source string, hash string").alias("r"))
    rows = parsed.where("r.kind is null or r.kind not in ('header', 'provenance-index')").select("r.*")
    word = lambda k: F.shiftleft(F.conv(F.substring("hash", 16 * k + 1, 8), 16, 10).try_cast("bigint"), 32).bitwiseOR(F.conv(F.substring("hash", 16 * k + 9, 8), 16, 10).try_cast("bigint"))
    good = F.coalesce(F.col("hash").rlike("^[0-9a-fA-F]{64}$") & F.col("source_pdf").isNotNull(), F.lit(False))
    return rows.select("source_pdf", "source_page", "source_diagram", "detection_source", F.when(good, F.array(*[word(k) for k in range(4)])).alias("words"), good.alias("readable"))


def read_census(spark: SparkSession, paths: str | list[str], schema: str = CENSUS) -> DataFrame:
    """Candidates (or, with REJECTION, rejections) of a detection census."""
    return spark.read.schema(schema).csv(paths, header=True)
