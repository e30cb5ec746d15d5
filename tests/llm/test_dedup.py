import brute
import corpus
import pytest
from pyspark.sql import functions as F

from boardmill.llm import windows
from boardmill.llm.exact_dedup import exact_dedup
from boardmill.llm.ngram_join import ngram_components
from boardmill.llm.substring_dedup import substring_dedup
from boardmill.llm.suffix_array import suffix_array
from boardmill.llm.suffix_dedup import suffix_dedup


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, corpus.SCHEMA).repartition(parts)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("text", ["", "a", "banana", "mississippi", "abababab", "zyxw", "aaaa", "abcabcabcab", "cabbage" * 5])
def test_suffix_array(text):
    codes = [ord(c) for c in text] + [0]
    assert suffix_array(codes) == sorted(range(len(codes)), key=lambda k: codes[k:])


def test_suffix_array_random():
    import random

    rng = random.Random(5)
    for _ in range(200):
        codes = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))] + [0]
        assert suffix_array(codes) == sorted(range(len(codes)), key=lambda k: codes[k:])


@pytest.mark.parametrize("flush", [1, 1 << 24])
def test_substring_dedup(spark, monkeypatch, flush):
    monkeypatch.setattr(windows, "FLUSH_BYTES", flush)
    rows = corpus.rows()
    got = substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    want = brute.substring(pairs(rows), 50)
    assert sorted(map(tuple, got)) == want
    assert sum(r[2] for r in want) > 500


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus.rows(seed)
    got = suffix_dedup(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect()
    want = brute.suffixes(pairs(rows), 100)
    assert sorted(map(tuple, got)) == want
    assert sum(r[2] for r in want) > 2000


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_components(spark, seed):
    rows = corpus.rows(seed)
    got = ngram_components(frame(spark, rows)).collect()
    want = brute.link_components(pairs(rows))
    assert sorted(map(tuple, got)) == want
    assert len({r[2] for r in want}) < len(rows) - 10


def test_ngram_links_beyond_stars(spark):
    """A chain of texts whose links no leader sees."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100]), "en", "s", 0) for k in range(40)]
    rows += [(100 + k, " ".join(words[30:130]) + f" extra{k}" * 4, "en", "s", 0) for k in range(5)]
    got = ngram_components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute.link_components(pairs(rows))


def test_exact_dedup(spark):
    rows = corpus.rows()
    got = {r.doc_id: r for r in exact_dedup(frame(spark, rows)).collect()}
    import hashlib
    import re

    groups = {}
    for i, t in pairs(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == len(rows)


def test_duplicate_groups(spark):
    """The refinement that hashes only what length and prefix leave, against counting."""
    import re
    from collections import Counter

    from boardmill.llm.exact_dedup import duplicate_groups

    rows = corpus.rows() + [(9_000 + k, "p" * 200 + "xyz"[k % 3] + "q" * 50, "en", "s", 0) for k in range(7)]
    texts = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs(rows))
    got = duplicate_groups(frame(spark, rows)).collect()
    assert sorted(r.group_size for r in got) == sorted(n for n in texts.values() if n > 1)
    first = {}
    for i, t in pairs(rows):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first[key] = min(first.get(key, i), i)
    assert {r.keep_id for r in got} == {first[t] for t, n in texts.items() if n > 1}
    assert duplicate_groups(frame(spark, rows).limit(0)).count() == 0


EDGES = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", None, None, None), (None, "a b c", None, None, None), (5, "", "en", "s", 0), (2, "a b c", "en", "s", 5), (2, "x " * 120, "en", "s", 5), (3, "x " * 120, "en", "s", 5)]


@pytest.mark.parametrize("operator", [exact_dedup, ngram_components, substring_dedup, suffix_dedup])
def test_odd_rows(spark, operator):
    """Nulls everywhere, repeated ids and rows, an empty table, clashing names."""
    docs = spark.createDataFrame(EDGES, corpus.SCHEMA).withColumn("keep_id", F.lit(1)).withColumn("n", F.lit(2)).withColumn("begin", F.lit("x"))
    assert operator(docs).count() == len(EDGES)
    assert operator(docs.limit(0)).count() == 0


def test_null_ids_are_last(spark):
    docs = spark.createDataFrame(EDGES, corpus.SCHEMA)
    found = {(r.doc_id, r.kept) for r in exact_dedup(docs).where("text = 'a b c'").collect()}
    assert found == {(None, False), (2, True)}


@pytest.mark.parametrize("name", ["op3_ngram_join", "op4_exact_dedup", "op5_substring_dedup", "op7_suffix_dedup", "op8_source_mixing"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from boardmill.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df, want = QUERIES[name](spark, folder), c.sql(ORACLE_SQL[name])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
