"""Substring deduplication: windows of words counted exactly through super-k-mer partitioning.

Words are ``[^\\x20\\x09-\\x0D]+``.  A word that a window covers is removed when the window's
word sequence also starts in a document with a smaller id.  Windows are judged on the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit
from .windows import Packed, first_of_equal, flagged_runs, merged, repeated_spans, with_spans

WINDOW = 50
MINIMISER = 8


def _joined_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, each with one space after it, starts and ends of the words in them, and each document's first."""
    starts, ends, first = textkit.word_bounds(data, offs)
    keep = ~textkit.SPACE[data]
    length = ends - starts
    at = np.cumsum(length + 1) - length - 1
    out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    out[textkit.ranges(at, length)] = data[keep]
    return out, at, at + length, first


def _exact_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only: hashes find the words to compare.

    Words of one length up to eight bytes have equal hashes only if they are equal.
    """
    codes, length = textkit.span_hash(raw, starts, ends), ends - starts
    order = np.argsort(codes)
    ranked = codes[order]
    begin = np.r_[True, ranked[1:] != ranked[:-1]] if len(order) else np.zeros(0, bool)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))]
    unlike = length != length[lead]
    long = np.flatnonzero((length > 8) & ~unlike & (lead != np.arange(len(lead))))
    unlike[long] = ~textkit.equal_spans(raw, starts[long], starts[lead[long]], length[long])
    own: dict[bytes, int] = {}
    for k in np.flatnonzero(unlike).tolist():
        lead[k] = own.setdefault(raw[starts[k] : ends[k]].tobytes(), k)
    return lead.astype(np.uint64)


def duplicate_word_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_id, _fp, begin, stop): word places that repeated windows cover; spans may overlap."""
    m = min(MINIMISER, window)

    def split(data: np.ndarray, offs: np.ndarray) -> tuple:
        text, starts, ends, first = _joined_words(data, offs)
        return text, starts, ends, first, textkit.rolling_hash(textkit.span_hash(text, starts, ends), m)

    def judge(got: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, _, _, count, _, size = got.fields
        offs = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        starts, ends, first = textkit.word_bounds(got.raw, offs)
        words = _exact_codes(got.raw, starts, ends)
        place = textkit.ranges(first[:-1], count.astype(np.int64))
        keys = textkit.rolling_hash(words, window)[place]
        doc = np.repeat(ids, count)
        lead = first_of_equal([keys], [doc])
        flag = doc[lead] < doc
        suspects = np.flatnonzero(lead != np.arange(len(lead)))
        for some in np.array_split(suspects, len(suspects) * window // 2_000_000 + 1):  # equal hashes: compare word by word
            step = np.arange(window)
            differ = (words[place[some][:, None] + step] != words[place[lead[some]][:, None] + step]).any(axis=1)
            for key in np.unique(keys[some[differ]]).tolist():
                smallest: dict[bytes, int] = defaultdict(lambda: 1 << 63)
                alike = np.flatnonzero(keys == np.uint64(key)).tolist()
                for k in alike:
                    text = words[place[k] : place[k] + window].tobytes()
                    smallest[text] = min(smallest[text], int(doc[k]))
                for k in alike:
                    flag[k] = smallest[words[place[k] : place[k] + window].tobytes()] < doc[k]
        bounds = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=bounds[1:])
        return flagged_runs(flag, bounds)

    return repeated_spans(docs, id_col, text_col, window, m, split, judge, within_document=False)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row; ids are integers.

    A null text has no word and an empty kept text.  Texts with fewer words than ``window``
    keep all.  Repeats inside one document, or in rows that share an id, are kept.  A row with
    a null id counts as having the largest id.  kept_text is the kept words joined by a space.
    Other columns are ignored.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                total, removed, kept = [], [], []
                for text, begins, stops in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    words = text.encode().split()
                    total.append(len(words))
                    if begins is None:
                        removed.append(0)
                    else:
                        left, done = [], 0
                        for a, b in merged(begins, stops):
                            left += words[done:a]
                            done = b
                        left += words[done:]
                        removed.append(len(words) - len(left))
                        words = left
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "kept_text"])

    rows = with_spans(docs, duplicate_word_spans(docs, id_col, text_col, window), id_col, text_col)
    return rows.mapInArrow(kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_text string")
