import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest

from boardmill.llm import importance
from boardmill.llm.importance import importance_resample, importance_weights, span_crc32

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)], len(words)


def brute(docs, target, buckets=10_000, longest=1, percent=10, least=20):
    own, theirs, found = Counter(), Counter(), {}
    for i, t in docs:
        grams, n = runs(t, longest)
        codes = [zlib.crc32(g) % buckets for g in grams]
        own.update(codes)
        old = found.get(i, ([], 0))
        found[i] = (old[0] + codes, old[1] + n)
    for t in target:
        theirs.update(zlib.crc32(g) % buckets for g in runs(t, longest)[0])
    s, t = sum(own.values()), sum(theirs.values())
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows, eligible = {}, []
    for i, (codes, n) in found.items():
        weight = sum(gain[b] for b in codes) // len(codes) if codes else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[i] = [len(codes), weight, score, None]
        if n >= least:
            eligible.append((-score, i))
    for k, (_, i) in enumerate(sorted(eligible)[: len(eligible) * percent // 100]):
        rows[i][3] = k + 1
    return {i: tuple(r) for i, r in rows.items()}


def as_dict(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def texts():
    docs = [(i, t) for i, t, *_ in corpus.rows(5, 120)]
    return docs, [t for _, t in docs[10:25]] + ["Alpha beta GAMMA delta1 " * 9, None, ""]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 64, 50), (3, 500, 100)])
def test_draw_equals_brute_force(spark, texts, longest, buckets, percent):
    docs, target = texts
    got = importance_resample(frame(spark, docs).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), buckets=buckets, longest=longest, percent=percent)
    want = brute(docs, target, buckets, longest, percent)
    assert as_dict(got) == want
    assert max(r[3] or 0 for r in want.values()) >= 8


def test_small_flushes_and_many_tasks_change_nothing(spark, texts, monkeypatch):
    docs, target = texts
    monkeypatch.setattr(importance, "FLUSH_POSTINGS", 500)
    monkeypatch.setattr(importance.textkit, "SLICE_BYTES", 2_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = as_dict(importance_resample(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(docs, target)


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (None, "d"), (4, "x " * 30), (4, "x y"), (5, "Ünï 1 ." * 40), (6, "." * 100), (7, "z" * 90_000 + " tail")]
    target = [("x y z " * 5,), (None,)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "'a' as score", "1 as rank", "2 as gain", "3 as _id", "4 as n_features")
    goal = spark.createDataFrame(target, "text string")
    assert as_dict(importance_resample(docs, goal)) == brute(rows, [t for t, in target])
    assert importance_resample(docs.limit(0), goal).count() == 0
    assert as_dict(importance_resample(docs, goal.limit(0))) == brute(rows, [])
    named = frame(spark, rows).selectExpr("cast(doc_id as string) as `key`", "text as body")
    assert {r.key for r in importance_weights(named, goal, "key", "body").collect()} == {None, "1", "2", "4", "5", "6", "7"}


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, i % 3, i != 4) for i in range(40)], "doc_id long, score long, eligible boolean")
    got = {r.doc_id: r["rank"] for r in importance.drawn_ranks(scored, "doc_id", 50).collect()}
    order = sorted((i for i in range(40) if i != 4), key=lambda i: (-(i % 3), i))[:19]
    assert {i: k for i, k in got.items() if k} == {i: k + 1 for k, i in enumerate(order)} and len(got) == 40


def test_crc32_of_spans():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(4_000))
    cuts = sorted(rng.sample(range(4_001), 200))
    starts, ends = np.array([0, *cuts]), np.array([*cuts, 4_000])
    assert span_crc32(np.frombuffer(data, np.uint8), starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]


def test_a_hot_bucket_is_dealt_to_many_tasks(spark, monkeypatch):
    """Postings of one word that is in every document meet in no single task."""
    monkeypatch.setattr(importance, "FLUSH_DOCS", 20)
    monkeypatch.setattr(importance.textkit, "SLICE_BYTES", 200)
    docs = frame(spark, [(i, f"hot w{i}") for i in range(2_000)]).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        seen = {}
        real = importance._contributions

        def watched(cogrouped, buckets, id_type):
            from pyspark.sql import functions as F

            seen["rows"] = [r.n for r in cogrouped.where("kind = 2 and shard = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            return real(cogrouped, buckets, id_type)

        monkeypatch.setattr(importance, "_contributions", watched)
        assert importance_weights(docs, docs.limit(5)).count() == 2_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen["rows"]) == 4 and max(seen["rows"]) < 0.5 * sum(seen["rows"])
