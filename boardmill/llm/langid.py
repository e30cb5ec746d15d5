"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased code points; everything that is no letter is a blank.  N-grams of one
to three characters are hashed to ``2**BITS`` places.  A document's value for a place is the
share of its n-grams there times the place's inverse document frequency, which counts all
documents of the learning folds.  The model is trained with FTRL and elastic-net penalties on a
bounded sample; the temperature of the probabilities is fitted on that sample too, each half scored by
a model of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .linear import Ftrl, bounded_sample, probabilities
from .quality import fold

BITS = 16
#: At most this many documents are fitted (and TRAIN_BYTES of features): of each language those with the smallest hash of
#: their id, as many of each as fit.
TRAIN_ROWS = 4_000
EPOCHS = 3
MASS = 30.0
BLOCK = 1 << 10
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For each code point its small letter, or a blank if it is no letter."""
    if not _tables:
        table = np.full(0x110000, 0x20, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _tables.append(table)
    return _tables[0]


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature places in document order, each document's first (n + 1), and whether it has a letter."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    bounds = lead[offs]
    codes = _lower_letters()[codes]
    letters = textkit.segment_sum(codes != 0x20, bounds) > 0
    n = len(codes)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    wide = codes.astype(np.uint64) + np.uint64(1)
    key, places, owners = wide, [], []
    for size in (1, 2, 3):
        if size > 1:
            key = key[: n - size + 1] * np.uint64(0x110001) + wide[size - 1 :]
        if len(key) == 0:
            continue
        m = len(key)
        good = (owner[:m] == owner[size - 1 : size - 1 + m]) & ((codes[:m] != 0x20) | (codes[size - 1 : size - 1 + m] != 0x20))
        places.append(np.where(good, textkit.mix(key * np.uint64(4) + np.uint64(size)) >> np.uint64(64 - BITS), np.uint64(1 << BITS)))
        owners.append(m)
    # three sorted runs are merged per document by place in a (document, order) layout
    if not places:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64), letters
    flat = np.full((n, 3), 1 << BITS, np.int64)
    for k, p in enumerate(places):
        flat[: len(p), k] = p
    return flat.ravel(), bounds * 3, letters


def document_frequency(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each place occurs, and the number of documents; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for _, offs, data in textkit.slices(batches, text_col):
            places, first, _ = ngrams(data, offs)
            own = np.repeat(np.arange(len(offs) - 1), np.diff(first)) << BITS + 1 | places
            own = np.sort(own)
            kept = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
            total += np.bincount(kept & (2 << BITS) - 1, minlength=(1 << BITS) + 1)[: 1 << BITS]
            n += len(offs) - 1
        if n:
            blocks = total.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.astype("<i8").tobytes() for b in blocks], pa.binary()), pa.array([n] * len(blocks), pa.int64())], ["block", "counts", "n"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in frame["counts"])
        return pd.DataFrame({"block": [key[0]], "counts": [np.asarray(total).astype("<i8").tobytes()], "n": [int(frame["n"].sum())]})

    schema = "block int, counts binary, n long"
    rows = docs.select(text_col).mapInArrow(count, schema).groupBy("block").applyInPandas(add, schema).collect()
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in rows:
        df[r.block * BLOCK : (r.block + 1) * BLOCK], n = np.frombuffer(r.counts, "<i8"), r.n
    return df, n


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict:
    """The model: langs, weights (idf included), bias, temperature."""
    learn = docs.where(F.col(lang_col).isNotNull() & (fold(id_col) != 0))
    df, n_docs = document_frequency(learn, text_col)
    idf = np.log((n_docs + 1) / (df + 1)) + 0.1
    # of each language its smallest hashes, as many of each as the bound allows
    by_hash = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ranked = learn.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= TRAIN_ROWS)
    chosen = ranked.orderBy("_n", F.xxhash64("_id"), "_id", "_lang").limit(TRAIN_ROWS).select("_id").distinct()
    texts = learn.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs, data in textkit.slices(batches, "_text"):
            places, first, letters = ngrams(data, offs)
            packed = []
            for a, b, some in zip(first[:-1].tolist(), first[1:].tolist(), letters.tolist(), strict=True):
                own = places[a:b]
                at, k = np.unique(own[own < 1 << BITS], return_counts=True)
                packed.append(at.astype("<i4").tobytes() + k.astype("<f4").tobytes() if some else b"")
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_lang"), pa.array(packed, pa.binary())], ["_id", "_lang", "packed"])

    packed = texts.select("_id", "_lang", "_text").mapInArrow(kernel, f"_id {dict(docs.dtypes)[id_col]}, _lang string, packed binary")
    order = [F.xxhash64("_id"), F.col("_id"), F.xxhash64("packed")]
    rows = []
    for r in bounded_sample(packed, order, TRAIN_ROWS):
        if half := len(r.packed) // 2:
            k = np.frombuffer(r.packed, "<f4", offset=half).astype(float)
            at = np.frombuffer(r.packed, "<i4", half // 4)
            rows.append((at, k * (MASS / k.sum()) * idf[at], r._lang))
    langs = sorted({lang for *_, lang in rows})
    if not langs:
        return {"learned": False, "langs": [UNKNOWN], "weights": np.zeros((1 << BITS, 1), np.float32), "bias": np.zeros(1), "temperature": 1.0}
    weights, bias = _fit(rows, langs)
    # the temperature is fitted on scores of models that haven't seen the row: those of the other half
    scores, right = [], []
    for half in (0, 1):
        own, rest = rows[half::2], rows[1 - half :: 2]
        if own and rest:
            other, other_bias = _fit(rest, langs)
            scores += [value @ other[at] + other_bias for at, value, _ in own]
            right += [langs.index(lang) for *_, lang in own]
    return {"learned": True, "langs": langs, "weights": (weights * idf[:, None] * MASS).astype(np.float32), "bias": bias, "temperature": _temperature(np.array(scores), np.array(right, int))}


def _fit(rows: list[tuple[np.ndarray, np.ndarray, str]], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    model = Ftrl(1 << BITS, max(2, len(langs)), alpha=0.2, l1=0.01, l2=0.05)
    targets = np.eye(max(2, len(langs)))
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, value, lang = rows[k]
            model.learn(at, value, targets[langs.index(lang)])
    weights, bias = model.weights()
    return weights[:, : len(langs)], bias[: len(langs)]


def _temperature(scores: np.ndarray, right: np.ndarray) -> float:
    """The temperature of least loss; 1 without scores."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), right]))

    return float(min(np.geomspace(0.2, 8, 60), key=loss))


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    Learns from text and non-null language of rows outside fold 0.  A null text, or one without
    a letter, gets ``und`` with score 0; so does every row if nothing could be learned.  A learned
    language may itself be called ``und``.  A
    language that no fitted row has can't be predicted.
    """
    model = train(docs, id_col, text_col, lang_col)
    langs = np.array(model["langs"])
    weights = np.vstack([model["weights"], np.zeros((1, len(langs)), np.float32)])
    bias, temperature, learned = model["bias"], model["temperature"], model["learned"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs, data in textkit.slices(batches, text_col):
            places, first, letters = ngrams(data, offs)
            used = textkit.segment_sum(places < 1 << BITS, first)
            dots = np.stack([textkit.segment_sum(weights[:, k][places], first) for k in range(len(langs))], axis=1)
            p = probabilities((dots / np.maximum(1, used)[:, None] + bias) / temperature) if len(langs) > 1 else np.ones((len(used), 1))
            best = p.argmax(axis=1)
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            if not learned:
                score = score * 0
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(id_col)), pa.array(np.where(letters, langs[best], UNKNOWN).tolist(), pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    scored = docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
    return scored.select(id_col, (fold(id_col) == 0).alias("held_out"), "lang_pred", "score")
