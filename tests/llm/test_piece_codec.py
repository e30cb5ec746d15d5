import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__
from boardmill.llm import piece_codec
from boardmill.llm.piece_codec import PieceCodec, _fields, encoded

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def with_map(rule, squeeze):
    """The model with the library's own compiled character map of a rule in place of the identity."""
    model = open(MODEL, "rb").read()
    if rule is None:
        return model
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = next(v for f, v in _fields(normaliser) if f == 3) + varint(4 << 3) + varint(squeeze)
    return model + varint(3 << 3 | 2) + varint(len(spec)) + spec


def texts():
    rng = random.Random(3)
    alphabet = "abcdefgh   \n\t▁éñ漢🙂019.,<>/ABC\u0000ﬁ½㍿　​ éＡ가ᄀ"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    out += ["", " ", "a", "▁", "▁▁▁", "   ", "the " * 700, "a" * 3000, "abc" * 900, " " * 900, "<s></s><unk>", "\n" * 20, "漢字" * 300, " a ", " ▁ a ▁ ", " ﬁ", "　", "x　　"]
    letters = "ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/"
    return out + ["".join(rng.choice(letters[6:32]) for _ in range(9_000)), "".join(rng.choice(letters) for _ in range(20_000))]


def packed(values):
    raw = [v.encode() for v in values]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)]


@pytest.mark.parametrize(("rule", "squeeze"), [(None, 0), ("nmt_nfkc", 0), ("nmt_nfkc", 1), ("nfkc_cf", 1)])
def test_ids_spans_and_decoded_texts_equal_the_library(rule, squeeze):
    model, values = with_map(rule, squeeze), texts()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), PieceCodec(model)
    data, offs = packed(values)
    ids, begins, first = codec.encode(data, offs)
    out, bounds = codec.decode(ids, first)
    for k, text in enumerate(values):
        own, at = ids[first[k] : first[k + 1]].tolist(), begins[first[k] : first[k + 1]].tolist()
        pieces = library.encode(text, return_type="proto").pieces
        assert own == library.encode(text, add_eos=True)
        assert at[:-1] == [p.begin for p in pieces] and at[1:] == [p.end for p in pieces]
        assert out[bounds[k] : bounds[k + 1]].tobytes().decode() == library.decode(own)


def test_decoding_of_any_ids_equals_the_library():
    library, codec, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.load(MODEL), random.Random(8)
    lists = [[rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 9))] for _ in range(4_000)]
    out, bounds = codec.decode(np.array([i for x in lists for i in x]), np.r_[0, np.cumsum([len(x) for x in lists])])
    raw = out.tobytes()
    assert [raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library.decode(lists)


def test_windows_and_forgotten_chunks_change_nothing(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    values = texts()[-2:] + ["aaaa" * 500, "thethethe" * 300]
    for window in (40, 200):
        monkeypatch.setattr(piece_codec, "WINDOW", window)
        codec = PieceCodec(open(MODEL, "rb").read())
        monkeypatch.setattr(piece_codec, "MAX_CHUNKS", 0)  # all chunks are learnt again for each slice
        for value in values:
            ids, _, first = codec.encode(*packed([value]))
            assert ids[: first[1]].tolist() == library.encode(value, add_eos=True)


def test_bytes_outside_characters_are_replaced_one_by_one():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.load(MODEL)
    raw = [b"a\xc3", b"\xa9b", b"\xff\xfe ok", b"", b"\xe6\xbc"]
    ids, _, first = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    for k, r in enumerate(raw):
        assert ids[first[k] : first[k + 1]].tolist() == library.encode(r.decode("utf-8", "surrogateescape").translate(dict.fromkeys(range(0xDC80, 0xDD00), "�")), add_eos=True)


def test_rows(spark):
    rows = [(1, None), (None, ""), (3, "é the"), (3, "é the"), (4, "漢" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as decoded", "2 as begins")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(((r.doc_id, r.n_bytes, list(r.ids), r.decoded) for r in encoded(docs, MODEL).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), library.encode(t or "", add_eos=True), t or "") for i, t in rows), key=repr)
    assert encoded(docs.limit(0), MODEL).count() == 0


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), len((r.text or "").encode()))
    got = {r.doc_id: tuple(r)[1:] for r in __spark_entry__.queries()["op12_piece_codec"](spark, folder).collect()}
    assert got == want


def test_other_models_are_refused():
    model = open(MODEL, "rb").read()
    unigram = varint(2 << 3 | 2) + varint(2) + varint(3 << 3) + varint(1)
    with pytest.raises(ValueError, match="only BPE"):
        PieceCodec(model + unigram)
