"""Suffix-array deduplication: bytes covered by a 100-byte string that also starts earlier.

Super-k-mers of bytes bring equal strings together (see ``windows``).  In a bucket those whose
minimiser nobody shares are unique; of the rest, equal super-k-mers are one string held by many
places, and the different strings of shared minimisers are sorted by the linear grouping suffix
array.  Window starts that follow each other in it with enough equal symbols are one class; of
the equal windows of a class the earliest stays, all others are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit
from .suffix_array import suffix_array
from .windows import Packed, first_of_equal, flagged_runs, merged, repeated_spans, with_spans

WINDOW = 100
MINIMISER = 12
#: Bytes of a symbol of the suffix array; at most ``2 * BLOCK - 1`` bytes of a window are left over.
BLOCK = 8
#: Bytes of different strings that are sorted at once; strings that share a minimiser stay together.
SORT_BYTES = 1 << 20


def duplicate_byte_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_id, _fp, begin, stop): byte places that repeated windows cover; spans may overlap."""
    m = min(MINIMISER, window)

    def split(data: np.ndarray, offs: np.ndarray) -> tuple:
        place = np.arange(len(data) + 1)
        return data, place[:-1], place[1:], offs, textkit.byte_run_hash(data, m)

    def judge(got: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, fps, place, count, mini, size = got.fields
        size = size.astype(np.int64)
        at = np.cumsum(size) - size
        # a shared window reaches half of what is beside the minimiser, or more, to one side or the other
        half = (window - m) // 2
        some = np.flatnonzero(_alike(got.raw, at, mini.astype(np.int64), size, m, half))
        if not len(some):
            return (np.zeros(0, np.int64),) * 3
        ids, fps, place, count, mini, size, at = (x[some] for x in (ids, fps, place, count, mini.astype(np.int64), size, at))
        bounds = np.zeros(len(some) + 1, np.int64)
        np.cumsum(count, out=bounds[1:])
        flag = np.zeros(bounds[-1], bool)
        lead = first_of_equal([_codes(got.raw, at, size), size], [ids, fps, place])
        repeat = lead != np.arange(len(lead))
        k = np.flatnonzero(repeat)  # equal hashes: compare the bytes
        repeat[k] = textkit.equal_spans(got.raw, at[k], at[lead[k]], size[k])
        flag[textkit.ranges(bounds[:-1][repeat], count[repeat].astype(np.int64))] = True
        # of each different string the earliest holder; those that share no side with another are done
        kinds = np.flatnonzero(~repeat)
        kinds = kinds[_alike(got.raw, at[kinds], mini[kinds], size[kinds], m, half)]
        codes = _codes(got.raw, at[kinds] + mini[kinds], m)
        order = np.argsort(codes, kind="stable")
        kinds, codes = kinds[order], codes[order]
        begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(kinds) else []
        total = np.r_[0, np.cumsum(size[kinds] + 1)]
        a = 0
        while a < len(begins):  # whole groups of one minimiser, about SORT_BYTES at a time
            b = max(a + 1, int(np.searchsorted(total[begins], total[begins[a]] + SORT_BYTES)))
            own = kinds[begins[a] : begins[b] if b < len(begins) else len(kinds)]
            a = b
            later = _later_windows([got.raw[x : x + n] for x, n in zip(at[own].tolist(), size[own].tolist(), strict=True)], mini[own], ids[own], fps[own], place[own], count[own], window)
            flag[textkit.ranges(bounds[own], count[own].astype(np.int64))[later]] = True
        row, begin, last = flagged_runs(flag, bounds)
        return some[row], begin, last

    return repeated_spans(docs, id_col, text_col, window, m, split, judge, within_document=True)


def _codes(raw: np.ndarray, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A hash of ``length`` bytes from each place; slices bound the memory."""
    out = np.empty(len(begin), np.uint64)
    length = np.broadcast_to(np.asarray(length, np.int64), len(begin))
    order = np.argsort(begin, kind="stable")
    lo, hi = begin[order], (begin + length)[order]
    k = 0
    while k < len(lo):
        e = max(k + 1, int(np.searchsorted(lo, lo[k] + textkit.SLICE_BYTES)))
        out[order[k:e]] = textkit.span_hash(raw[lo[k] : int(hi[k:e].max())], lo[k:e] - lo[k], hi[k:e] - lo[k])
        k = e
    return out


def _alike(raw: np.ndarray, at: np.ndarray, mini: np.ndarray, size: np.ndarray, m: int, half: int) -> np.ndarray:
    """Whether another string has the same minimiser and ``half`` bytes before it, or after it."""
    shared = np.zeros(len(at), bool)
    for fits, begin in ((np.flatnonzero(mini >= half), at + mini - half), (np.flatnonzero(mini + m + half <= size), at + mini)):
        codes = _codes(raw, begin[fits], m + half)
        order = np.argsort(codes)
        same = codes[order][1:] == codes[order][:-1]
        shared[fits[order[1:][same]]] = True
        shared[fits[order[:-1][same]]] = True
    return shared


def _later_windows(strings: list[np.ndarray], mini: np.ndarray, ids: np.ndarray, fps: np.ndarray, place: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """For the windows of these strings, one after another: whether an equal one starts earlier.

    Equal windows stand alike to their minimisers, so the suffix array may work on blocks of
    bytes that are counted from the minimiser: ``whole`` blocks lie inside any window, suffixes
    that share as many are one class, and windows of a class are equal if the bytes that are
    left over on both sides are.
    """
    block = BLOCK if window >= 2 * BLOCK else 1
    whole = (window - block + 1) // block
    spare = window - whole * block
    count = count.astype(np.int64)
    skip = mini.astype(np.int64) % block
    raw = np.concatenate([*strings, np.zeros(window, np.uint8)])
    size = np.array([len(s) for s in strings])
    at = np.cumsum(size) - size
    blocks = (size - skip) // block
    # the blocks of every string and a separator after each, all as numbers in the order of their bytes
    first = np.cumsum(blocks + 1) - (blocks + 1)
    begin = textkit.ranges(np.zeros(len(size), np.int64), blocks) * block + np.repeat(at + skip, blocks)
    named = np.lib.stride_tricks.sliding_window_view(raw, block)[begin]
    named = np.ascontiguousarray(named).view(f">u{block}").ravel() if block in (1, 2, 4, 8) else named
    text = np.ones(int((blocks + 1).sum()) + 1, np.int64)
    text[-1] = 0
    text[textkit.ranges(first, blocks)] = np.unique(named, return_inverse=True)[1] + 2
    full = np.zeros(len(text), bool)
    full[textkit.ranges(first, np.maximum(0, blocks - whole + 1))] = True
    order = np.array(suffix_array(text.tolist()))
    order = order[full[order]]
    views = np.lib.stride_tricks.sliding_window_view(text, whole)
    new = np.ones(len(order), np.int64)
    for k in range(1, len(order), 20_000):
        e = min(len(order), k + 20_000)
        new[k:e] = (views[order[k:e]] != views[order[k - 1 : e - 1]]).any(axis=1)
    label = np.zeros(len(text), np.int64)
    label[order] = np.cumsum(new)
    # each window: the class of the first block that starts in it, how far that is, and the bytes left over
    owner = np.repeat(np.arange(len(size)), count)
    offset = textkit.ranges(np.zeros(len(size), np.int64), count)
    ahead = (skip[owner] - offset) % block
    key = label[first[owner] + (offset + ahead - skip[owner]) // block] * block + ahead
    holders = np.bincount(key)
    some = np.flatnonzero(holders[key] > 1)
    later = np.zeros(len(key), bool)
    if len(some):
        owner, offset, ahead = owner[some], offset[some], ahead[some]
        start = at[owner] + offset
        rest = np.zeros((len(some), 16), np.uint8)
        for j in range(spare):
            rest[:, j] = raw[start + j + np.where(j < ahead, 0, whole * block)]
        parts = rest.view("<u8")
        lead = first_of_equal([key[some], parts[:, 0], parts[:, 1]], [ids[owner], fps[owner], place[owner] + offset])
        later[some] = lead != np.arange(len(some))
    return later


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_bytes) of every row; ids are integers.

    A null text has no byte.  Texts shorter than ``window`` bytes keep all.  Rows that share an
    id are ordered by a hash of their texts; those that share the text too are judged as one and
    lose the same bytes, none to each other.  A row with a null id counts as having the largest
    id.  kept_bytes need not be valid UTF-8.  Other columns are ignored.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                total, removed, runs, kept = [], [], [], []
                for text, begins, stops in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw = text.encode()
                    total.append(len(raw))
                    cuts = merged(begins, stops) if begins else []
                    left, done = [], 0
                    for a, b in cuts:
                        left.append(raw[done:a])
                        done = b
                    left.append(raw[done:])
                    kept.append(b"".join(left))
                    removed.append(len(raw) - len(kept[-1]))
                    runs.append(len(cuts))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, runs)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    rows = with_spans(docs, duplicate_byte_spans(docs, id_col, text_col, window), id_col, text_col)
    return rows.mapInArrow(kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
