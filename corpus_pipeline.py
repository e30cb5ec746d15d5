"""The corpus pipeline: five stages from raw documents to a mixed training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's ``docs``.  All but the last return the columns of documents.  Nulls, empty tables
and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardmill.llm import quality
from boardmill.llm.decontaminate import decontaminated
from boardmill.llm.exact_dedup import first_copies
from boardmill.llm.mixing import FINE_QUANTUM, mix_sources
from boardmill.llm.ngram_join import ngram_components
from boardmill.llm.storage import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.training_rows(docs, labels, "doc_id", "text", "quality"))
    # the rows travel as one column, so that none of theirs meets the score
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score(rows, model, ["row"]).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id."""
    return first_copies(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of shingle sets the one with the smallest id."""
    return docs.join(ngram_components(docs).where("doc_id != component_id").select("doc_id").distinct(), "doc_id", "left_anti")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their places in the mixed order."""
    return mix_sources(docs, quantum=FINE_QUANTUM, nearest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_first_copies),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("source mixing", mix),
]

#: No SQL: the classifier is a fitted model.  Tested against brute-force stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
