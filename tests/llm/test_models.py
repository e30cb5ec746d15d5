import random
import re
from fractions import Fraction

import corpus
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from boardmill.llm import decontaminate, mixing
from boardmill.llm.decontaminate import ItemIndex, contaminated, decontaminated
from boardmill.llm.langid import language_scores
from boardmill.llm.licenses import TEMPLATES, licence_paragraphs
from boardmill.llm.mixing import mix_sources, pfair_period, whole_shares
from boardmill.llm.quality import quality_scores
from boardmill.llm.token_count import PieceTransducer, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def edit_distance(item, text):
    """Least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_token_counts_equal_the_library():
    rng = random.Random(3)
    alphabet = "abcdefgh   \n\t▁éñ漢🙂019.,<>/ABC\u0000"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["", " ", "a", "▁", "the " * 700, "a" * 3000, "abc" * 900, " " * 900, "<s></s><unk>", "\n" * 20, "漢字" * 300]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [len(t) for t in library.encode(texts, num_threads=1)]
    machine = PieceTransducer(MODEL)
    assert machine.count(texts).tolist() == want
    assert np.concatenate([machine.count([t]) for t in texts]).tolist() == want


def test_token_counts_of_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "", "x"), (3, "é the", None), (3, "é the", None)], "doc_id long, text string, n_tokens string")
    assert sorted(map(tuple, token_counts(docs, MODEL).collect()), key=str) == sorted([(1, 0, 0), (None, 0, 0), (3, 6, 2), (3, 6, 2)], key=str)
    assert token_counts(docs.limit(0), MODEL).count() == 0


ITEMS = [(k, " ".join(random.Random(k).choice(["the", "onea", "rest", "ing", "thand", "ou", "sh", "er"]) + str(random.Random(k * j).randint(0, 9)) for j in range(12 + k))) for k in range(12)]


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    docs = []
    for k in range(80):
        words = [rng.choice(["the", "onea", "rest", "ing", "thand", "ou", "sh", "er"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 90))]
        if k % 2:
            item = list(ITEMS[rng.randrange(len(ITEMS))][1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
            words.insert(len(words) // 2, "".join(item).upper() if k % 4 == 1 else "".join(item))
        docs.append((k, rng.choice([" ", "\n ", "  "]).join(words)))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)  # several passes
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).strip().lower()
    budgets = dict(zip((i for i, _ in ITEMS), ItemIndex([i for i, _ in ITEMS], [t for _, t in ITEMS]).budget.tolist(), strict=True))
    want = {(d, i): n for d, t in docs for i, item in ITEMS if (n := edit_distance(clean(item), clean(t))) <= budgets[i]}
    benchmark = spark.createDataFrame(ITEMS + [(99, None), (98, ""), (97, "short")], "item_id long, text string")
    frame = spark.createDataFrame(docs + [(500, None), (501, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(frame, benchmark).collect()}
    assert got == want and len(want) > 20 and len(set(want.values())) > 3
    assert {r.doc_id for r in decontaminated(frame, benchmark).collect()} == {d for d, _ in docs + [(500, 0), (501, 0)]} - {d for d, _ in want}
    assert contaminated(frame.limit(0), benchmark).count() == 0 and contaminated(frame, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, None: 0.2}, {f"s{k}": 1 + k % 7 for k in range(30)}])
def test_pfair_period(weights):
    shares = whole_shares(weights)
    assert sum(shares.values()) == mixing.QUANTUM
    done = dict.fromkeys(shares, 0)
    for t, (s, j, slot) in enumerate(pfair_period(shares), 1):
        assert (slot, j) == (t - 1, done[s])
        done[s] += 1
        assert all(abs(done[x] - Fraction(shares[x] * t, mixing.QUANTUM)) < 1 for x in shares)


def test_mixing_keeps_every_row(spark):
    rows = [(k, None if k % 5 == 0 else f"src{k % 3}", k) for k in range(700)] + [(None, "src1", 1), (7, "src1", 1), (7, "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot long")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) == len({r.mix_position for r in got})
    for source in {r.source for r in got}:
        own = sorted((r for r in got if r.source == source), key=lambda r: r.mix_position)
        assert [r.block for r in own] == [k // mixing.BLOCK_ROWS for k in range(len(own))]
    assert mix_sources(docs.limit(0)).count() == 0


def test_licences(spark):
    docs = [(k, f"words of prose\n{t}\nmore words", n) for k, (n, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]
    docs += [(1000, None, ""), (1001, "", ""), (1002, "She lost her driving license in the public park", ""), (1003, "plain prose", "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, family string")
    got = {r.doc_id: r for r in licence_paragraphs(frame).collect()}
    wrong = [(n, got.get(k)) for k, _, n in docs if n and (k not in got or got[k].family not in (n, "unknown"))]
    assert not wrong
    assert sum(got[k].family == n for k, _, n in docs if n) > 0.85 * len(docs)
    assert all(got[k].paragraph == 1 and got[k].confirmed for k, _, n in docs if n and got[k].family == n)
    assert not {1000, 1001, 1002, 1003} & got.keys()
    odd = licence_paragraphs(spark.createDataFrame([(1, "This is licensed under the Frobnicate License of the parties.")], "doc_id long, text string")).collect()
    assert [r.family for r in odd] in ([], ["unknown"])


def classified(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        good = k % 4 > 0
        lang = ["en", "fr"][k % 2]
        words = [rng.choice({"en": ["the", "and", "thing", "with"], "fr": ["le", "élan", "avec", "où"]}[lang]) for _ in range(rng.randint(3, 60))]
        docs.append((k, " ".join(words if good else [w + "$$$" for w in words]), lang, "s", 0))
        labels.append((k, int(good), 0))
    odd = [(10_000, None, None, None, None), (10_001, "", None, None, None), (10_002, "123 !!", "en", "s", 0), (None, "the and", "en", "s", 0)]
    return spark.createDataFrame(docs + odd, corpus.SCHEMA), spark.createDataFrame(labels + [(5, 0, None), (None, 1, 1), (77777, 1, 0), (10_001, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = classified(spark)
    got = quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 10_000]
    assert held and sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) > 0.97 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_language(spark):
    docs, _ = classified(spark)
    got = language_scores(docs).collect()
    assert all(r.lang_pred == ["en", "fr"][r.doc_id % 2] for r in got if r.doc_id is not None and r.doc_id < 10_000)
    assert {r.lang_pred for r in got if r.doc_id is not None and r.doc_id >= 10_000} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_scores(none).collect()} == {"und"}
    assert language_scores(docs.limit(0)).count() == 0
