"""Inputs on which hashes or hot keys would give wrong results or no end."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from boardmill.llm import textkit, windows
from boardmill.llm.ngram_join import ngram_components
from boardmill.llm.substring_dedup import substring_dedup
from boardmill.llm.suffix_dedup import suffix_dedup

DOC = "doc_id long, text string"


def parity_pair():
    """Two different strings whose polynomial hashes modulo 2**64 are equal for any odd base."""
    t = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    return t, t.translate(str.maketrans("ab", "ba"))


def parity_rows():
    t, u = parity_pair()
    words = " ".join(f"w{k}" for k in range(49))
    return [(1, f"{words} {t}"), (2, f"{words} {u}"), (3, t), (4, u), (5, u)]


def words_of(got):
    return sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()))


def bytes_of(got):
    return sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect()))


def test_parity_strings_are_told_apart(spark):
    rows = parity_rows()
    frame = spark.createDataFrame(rows, DOC)
    assert words_of(substring_dedup(frame)) == brute.substring(rows, 50)
    assert bytes_of(suffix_dedup(frame)) == brute.suffixes(rows, 100)
    assert sorted(map(tuple, ngram_components(frame).collect())) == brute.link_components(rows)


def test_hashes_that_collide_change_nothing(spark, monkeypatch):
    """With a hash of two bits nearly everything collides; results must come from the bytes."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(30)}" for _ in range(400)]
    rows = [(k, " ".join(base[(at := rng.randrange(300)) : at + rng.randint(10, 100)] + [rng.choice("ab") * rng.randint(1, 30)])) for k in range(30)]
    data = np.frombuffer(" ".join(t for _, t in rows).encode(), np.uint8)
    starts, ends, _ = textkit.word_bounds(data, np.array([0, len(data)]))
    same = textkit.equal_spans(data, starts[:-1], starts[1:], (ends - starts)[1:])
    assert all(s == (data[a : a + n].tobytes() == data[b : b + n].tobytes()) for s, a, b, n in zip(same.tolist(), starts[:-1].tolist(), starts[1:].tolist(), (ends - starts)[1:].tolist(), strict=True))
    from boardmill.llm import substring_dedup as words

    lead = words._exact_codes(data, starts, ends)
    text = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    monkeypatch.setattr(textkit, "span_hash", lambda data, starts, ends: (np.asarray(ends) - np.asarray(starts)).astype(np.uint64) & np.uint64(3))
    again = words._exact_codes(data, starts, ends)
    long = [len(w) > 8 for w in text]  # the short ones rely on a hash that is one to one for them
    assert len({c for c, x in zip(again.tolist(), long, strict=True) if x}) == len({w for w in text if len(w) > 8})
    for codes in (lead,):
        assert len({(c, w) for c, w in zip(codes.tolist(), text, strict=True)}) == len(set(text)) == len(set(codes.tolist()))


@pytest.mark.parametrize("bucket", [0, 1_000])
def test_hot_minimisers_are_split(spark, monkeypatch, bucket):
    """``bucket`` 0: all are hot; else those of the common phrase."""
    monkeypatch.setattr(windows, "HOT", min(bucket, 4))
    monkeypatch.setattr(windows, "BUCKET_BYTES", bucket or 100_000)
    rng = random.Random(9)
    phrase = " ".join(f"common{k}" for k in range(60))
    rows = []
    for k in range(60):
        w = lambda: " ".join(f"x{rng.randrange(9)}" for _ in range(rng.randint(0, 70)))
        rows.append((k, f"{w()} {phrase[rng.randint(0, 300) :]} {w()} the same eight words stand here in all {w()}"))
    frame = spark.createDataFrame(rows, DOC).repartition(4)
    assert words_of(substring_dedup(frame)) == brute.substring(rows, 50)
    assert bytes_of(suffix_dedup(frame)) == brute.suffixes(rows, 100)


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(4_000)}" for _ in range(60_000))
    rows = [(1, long), (2, "x" * 300_000), (3, long[:200_000] + " and another end"), (4, None), (5, long + " z"), (6, "y " * 60_000)]
    frame = spark.createDataFrame(rows, DOC)
    assert words_of(substring_dedup(frame)) == brute.substring(rows, 50)
    assert sorted(map(tuple, ngram_components(frame).collect())) == brute.link_components(rows)
    got = {r[0]: r for r in bytes_of(suffix_dedup(frame))}
    assert got[1][2] < 1_000 and got[2][1:4] == (300_000, 299_999, 1) and got[5][2] >= len(long) - 100 and got[6][2] == 119_998
