"""Learned operators: held-out quality on the given documents, features against plain versions, odd labels."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from boardmill.llm import langid, linear, quality, textkit
from boardmill.llm.decontaminate import ItemIndex
from boardmill.llm.langid import language_scores
from boardmill.llm.quality import quality_scores

FOLDER = "/root/testdata/sf0.01"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    assert len(rows) > 50 and auc([(r.score, r.quality) for r in rows]) > 0.97
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language_scores(docs).where("held_out and lang_pred != 'und'").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) > 0.98 * len(rows)
    # calibrated: the mean score is near the share of right answers
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.lang_pred == r.lang for r in rows])) < 0.05


def test_scores_equal_a_plain_dot_product(spark):
    """The kernel over batches against one document at a time."""
    rng = random.Random(1)
    texts = ["", "The END!! 12", "é a\tb", "a " * 50] + [" ".join(rng.choice(["The", "x9", "$$$", "naïve", "end."]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    weights = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    got = {r.k: r.score for r in quality.score(frame, (weights, 0.25), ["k"]).collect()}
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        places, first = quality.features(raw, np.array([0, len(raw)]))
        total = math.fsum(float(weights[p]) for p in places.tolist()) * quality.MASS / max(1, len(places)) + 0.25
        assert first.tolist() == [0, len(places)] and abs(got[k] - 1 / (1 + math.exp(-total))) < 1e-6


def test_language_features_equal_a_plain_version():
    """N-grams of a batch against those of each text by itself."""
    texts = ["", "a", "Ab cé", "  x1y ", "ß漢字 z"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    places, first, letters = langid.ngrams(data, offs)
    for k, r in enumerate(raw):
        own, _, some = langid.ngrams(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        real = lambda p: sorted(x for x in p.tolist() if x < 1 << langid.BITS)
        assert real(places[first[k] : first[k + 1]]) == real(own) and letters[k] == (some[0] if len(some) else False)
        word = "".join(c.lower() if c.isalpha() else " " for c in texts[k])
        want = sum(1 for n in (1, 2, 3) for i in range(len(word) - n + 1) if word[i] != " " or word[i + n - 1] != " ")
        assert len(real(own)) == want


def test_document_frequency_counts_each_document_once(spark):
    texts = [("aa aa",), ("aa",), (None,), ("b",)]
    df, n = langid.document_frequency(spark.createDataFrame(texts, "text string"), "text")
    place = int(textkit.mix(np.array([ord("a") + 1], np.uint64) * np.uint64(4) + np.uint64(1))[0] >> np.uint64(64 - langid.BITS))
    assert n == 4 and df[place] == 2


def test_a_language_called_und(spark):
    rows = [(k, ["the thing", "le chat"][k % 2] + f" {k}", ["und", "zz"][k % 2]) for k in range(200)]
    got = language_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"und", "zz"} and min(r.score for r in got) > 0.5


def test_rare_languages_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 60)
    rows = [(k, "the thing and that", "en") for k in range(3_000)] + [(5_000 + k, "ça où été", "fr") for k in range(12)]
    got = language_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 5000").collect()
    assert {r.lang_pred for r in got} == {"fr"}


def test_few_rows_and_very_long_texts(spark):
    rows = [(k, ["the thing ", "le chat "][k % 2] * (50_000 if k < 2 else 3), ["en", "fr"][k % 2]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == ["en", "fr"][r.doc_id % 2] for r in language_scores(docs).collect())
    assert quality_scores(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))).count() == 12


def test_samples_are_bounded_in_bytes(spark):
    packed = spark.createDataFrame([(k, b"x" * 100) for k in range(50)], "_id long, packed binary")
    got = linear.bounded_sample(packed, [F.xxhash64("_id"), F.col("_id")], 50, 1_000)
    assert len(got) == 10 and len(linear.bounded_sample(packed, [F.col("_id")], 50, 99)) == 0
    assert [r._id for r in linear.bounded_sample(packed, [F.col("_id")], 7)] == list(range(7)) and len(linear.bounded_sample(packed, [F.col("_id")], 60)) == 50


def test_repeated_grams_are_counted_in_parts(monkeypatch):
    from boardmill.llm import decontaminate

    item, text = "-" * 700 + " end of it", ("=" * 50 + "-" * 900 + " end of it" + "-" * 300).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = ItemIndex([1], [item]).search(data, offs)
    monkeypatch.setattr(decontaminate, "POSTINGS", 1_000)
    assert whole and ItemIndex([1], [item]).search(data, offs) == whole
    assert whole[0][2] == 0 and text[whole[0][3] : whole[0][4]] == item.encode()
