"""Document quality: hashed word n-gram logistic regression, trained with FTRL, scored as sparse dot products.

Words are runs of letters, digits and non-ASCII bytes, or runs of other visible characters, in
lower case.  Features are single words, pairs of successive words (one common feature for a word
that repeats itself) and pairs of word shapes (capitals, digits, marks), each hashed to one of
``2**BITS`` places and weighted by its share of the document's features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .linear import Ftrl, bounded_sample, probabilities

BITS = 17
#: At most this many labelled rows are fitted, those with the smallest hash of their id.
TRAIN_ROWS = 6_000
EPOCHS = 4
THRESHOLD = 0.3
#: A document's features sum to this.
MASS = 40.0
#: 0 white space, 1 small letter or non-ASCII, 2 capital letter, 3 digit, 4 other
KIND = np.full(256, 4, np.uint8)
KIND[textkit.SPACE] = 0
KIND[97:123] = KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out, as is a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature places in document order, and each document's first (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = KIND[data]
    group = np.where(kind == 4, 2, np.minimum(kind, 1))
    begin = np.ones(len(data), bool)
    begin[1:] = group[1:] != group[:-1]
    begin[offs[:-1][np.diff(offs) > 0]] = True
    edges = np.flatnonzero(begin)
    ends = np.r_[edges[1:], len(data)]
    word = group[edges] > 0
    starts, ends = edges[word], ends[word]
    first = np.searchsorted(starts, offs)
    words = textkit.span_hash(textkit.LOWER[data], starts, ends)
    last = ends - 1
    shape = (kind[starts].astype(np.uint64) * np.uint64(5) + kind[np.minimum(starts + 1, last)]) * np.uint64(5) + kind[last]
    shape = np.where(kind[starts] == 4, data[starts].astype(np.uint64) + np.uint64(256), shape)
    n = len(words)
    same = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pair = np.flatnonzero(same[1:] == same[:-1])
    again = words[pair] == words[pair + 1]
    pairs = np.where(again, np.uint64(7), textkit.mix(words[pair] * np.uint64(3) + words[pair + 1]))
    shapes = textkit.mix(shape[pair] * np.uint64(1 << 20) + shape[pair + 1] + np.uint64(1 << 50))
    places = np.concatenate([words, pairs, shapes]) >> np.uint64(64 - BITS)
    places[n : n + len(pair)][again] = 7
    owner = np.concatenate([same, same[pair], same[pair]])
    order = np.argsort(owner, kind="stable")
    return places[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(offs)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places, counts, label) of the fitted rows, as views of what came packed; bounded by TRAIN_ROWS, and by TRAIN_BYTES of features."""
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(TRAIN_ROWS)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs, data in textkit.slices(batches, "_text"):
            places, first = features(data, offs)
            packed = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                at, n = np.unique(places[a:b], return_counts=True)
                packed.append(at.astype("<i4").tobytes() + n.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_label"), pa.array(packed, pa.binary())], ["_id", "_label", "packed"])

    found = texts.select("_id", "_label", "_text").mapInArrow(kernel, f"_id {dict(docs.dtypes)[id_col]}, _label int, packed binary")
    found = bounded_sample(found, [F.xxhash64("_id"), F.col("_id"), F.xxhash64("packed")], TRAIN_ROWS)
    out = []
    for r in found:
        half = len(r.packed) // 2
        out.append((np.frombuffer(r.packed, "<i4", half // 4), np.frombuffer(r.packed, "<f4", offset=half), r._label))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias; all zero without rows."""
    model = Ftrl(1 << BITS, 1, alpha=0.3, l1=0.02, l2=0.1)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            places, n, label = rows[k]
            n = n.astype(float)
            model.learn(places, n * (MASS / max(n.sum(), 1)), np.array([label], float))
    weights, bias = model.weights()
    return weights[:, 0].astype(np.float32), float(bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and ``name``, its score from 0 to 1.  Empty and null texts get the bias's score."""
    weights, bias = model
    types = dict(docs.dtypes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs, data in textkit.slices(batches, text_col):
            places, first = features(data, offs)
            dots = textkit.segment_sum(weights[places].astype(float), first) * MASS / np.maximum(1, np.diff(first)) + bias
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(probabilities(dots[:, None])[:, 0])], [*keep, name])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{name}` double"])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(kernel, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    Learns only from labelled rows outside fold 0.  Null or other labels are ignored, repeated
    labels of one id count once, with the smaller value; labels without a document don't count.
    Without any label every score is 0.5.  Columns beside id and text are never read.
    """
    model = fit(training_rows(docs, labels, id_col, text_col, label_col))
    scored = score(docs, model, [id_col], text_col)
    return scored.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
