"""Columns of the input may have any name, those that the operators use inside included."""

import os
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from boardmill import llm
from boardmill.llm.decontaminate import contaminated, decontaminated
from boardmill.llm.exact_dedup import exact_dedup
from boardmill.llm.licenses import licence_paragraphs
from boardmill.llm.mixing import QUANTUM, mix_sources
from boardmill.llm.ngram_join import ngram_components
from boardmill.llm.substring_dedup import substring_dedup
from boardmill.llm.suffix_dedup import suffix_dedup

ROWS = [(1, "a b c d e f", "en", "s", 5), (2, "a b c d  e f", "en", None, 5), (3, "Released under the MIT License.", None, "s", 5), (None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def inner_names():
    """Every quoted name in the sources that could be a column."""
    folder, found = os.path.dirname(llm.__file__), set()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".py"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                found |= set(re.findall(r'"(_?[a-z][a-z0-9_]{0,15})"', f.read()))
    return sorted(found - {c.split()[0] for c in SCHEMA.split(", ")})


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("mine").alias(n) for n in inner_names()])


RESULTS = {"exact_dedup": {"text_sha256", "keep_id", "group_size", "kept"}, "mix_sources": {"block", "slot", "mix_position"}}


@pytest.mark.parametrize("quantum", [None, QUANTUM])
def test_rows_keep_their_columns(spark, docs, quantum):
    assert len(inner_names()) > 60
    for name, got in (("exact_dedup", exact_dedup(docs)), ("mix_sources", mix_sources(docs, quantum=quantum))):
        rows = got.collect()
        own = [c for c in docs.columns if c not in RESULTS[name]]
        assert len(rows) == len(ROWS) and set(got.columns) == set(docs.columns) | RESULTS[name]
        assert {tuple(r[c] for c in own[:5]) for r in rows} == set(ROWS)
        assert {r[c] for r in rows for c in own[5:]} == {"mine"}


def test_results_stay_the_same(spark, docs):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    items = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    for operator in (ngram_components, substring_dedup, suffix_dedup, licence_paragraphs, lambda d: contaminated(d, items)):
        assert sorted(map(repr, operator(docs).collect())) == sorted(map(repr, operator(plain).collect()))
    assert decontaminated(docs, items).columns == docs.columns


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "under the moon")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.collect()
