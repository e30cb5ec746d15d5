import random

import corpus
import pytest
from pyspark.sql import functions as F

from boardmill.llm import exact_dedup as ed


@pytest.mark.parametrize("bits", [18, 4])
def test_first_copies_are_the_rows_that_exact_dedup_keeps(spark, monkeypatch, bits):
    monkeypatch.setattr(ed, "FLAG_BITS", max(bits, 6))  # few flags: nearly all rows share one
    rng = random.Random(bits)
    rows = corpus.rows(3, 80)
    texts = [r[1] for r in rows]
    rows += [(900 + k, (rng.choice(texts) or "").replace(" ", rng.choice(["  ", "\n", " "])), "en", "s", 1) for k in range(60)]
    rows += [rows[0], rows[0], (None, texts[4], "en", "s", 1), (None, "only null", None, None, None), (None, "only null", None, None, None), (rows[5][0], "another text of this id", "en", "s", 1), (3, "L" * 200_000, "en", "s", 1), (5, "L" * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(4).selectExpr("*", "1 as kept", "'x' as digest", "2 as _id", "3 as _raw", "4 as _row")
    plain = lambda df: sorted(map(tuple, df.select(*docs.columns).collect()), key=repr)
    want = ed.exact_dedup(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).where("kept").select("row.*")
    got = ed.first_copies(docs)
    assert got.columns == docs.columns and plain(got) == plain(want)
    assert ed.first_copies(docs.limit(0)).count() == 0


def test_only_survivors_are_hashed_in_full(spark):
    docs = spark.createDataFrame([(1, "aa b"), (2, "aa  b"), (3, "cc b"), (4, "quite another length")], "doc_id long, text string")
    assert sorted((r["_id"], len(r.digest)) for r in ed._survivors(docs, "doc_id", "text").collect()) == [(1, 64), (2, 64)]
    assert {r.keep_id: r.group_size for r in ed.duplicate_groups(docs).collect()} == {1: 2}
