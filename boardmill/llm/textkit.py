"""Vectorised text kernels shared by the Python-side operators.

Texts arrive as Arrow batches.  Every kernel works on *slices*: whole documents whose
bytes sum to about ``SLICE_BYTES`` (one longer document makes a slice of its own), so the
memory of a task is bounded by the slice and the longest document, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_PLACE = U64(0xC2B2AE3D27D4EB4F)
#: Bytes of spans that are compared at once.
COMPARE_BYTES = 4 << 20

#: True for the bytes 0x20 and 0x09..0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and the bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs, raw


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", budget: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets from 0, bytes) of successive slices of whole documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs, raw = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + budget, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), offs[at : end + 1] - offs[at], raw[offs[at] : offs[end]]
            at = end


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each document's first word (n + 1)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(SPACE[data], out=inside[:n])
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    stop = inside[:n] & ~inside[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] |= inside[inner]
    stop[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; bytes after the end are 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _blocks(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of eight bytes of each span, the last one filled up with 0, their numbers in the span, and each span's first."""
    count = (lengths + 7) >> 3
    step = ranges(np.zeros(len(starts), np.int64), count)
    value = view[np.repeat(starts, count) + 8 * step]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    cut = np.flatnonzero(lengths & 7)
    value[bounds[cut + 1] - 1] &= (U64(1) << ((lengths[cut] & 7) * 8).astype(U64)) - U64(1)
    return value, step, bounds


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands.

    Each block of eight bytes is scrambled together with its number before the blocks are summed,
    so that no pattern of symbols makes spans collide.
    """
    lengths = (ends - starts).astype(np.int64)
    value, step, bounds = _blocks(eights(data), np.asarray(starts, np.int64), lengths)
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(mix(mix(value) + step.astype(U64) * _PLACE), out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + lengths.astype(U64) * _ODD)


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[a : a + length] and data[b : b + length] are the same bytes, for each pair of spans."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    view, total, at = eights(data), np.cumsum(lengths), 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARE_BYTES, "right")))
        one, _, bounds = _blocks(view, a[at:end], lengths[at:end])
        two, *_ = _blocks(view, b[at:end], lengths[at:end])
        differ = np.zeros(len(one) + 1, np.int64)
        np.cumsum(one != two, out=differ[1:])
        out[at:end] = differ[bounds[1:]] == differ[bounds[:-1]]
        at = end
    return out


def rolling_hash(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` successive codes (len(codes) - length + 1 of them).

    Runs of 1, 2, 4, .. codes are scrambled in pairs; those that make up ``length`` are chained.
    """
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, size, done, out = mix(codes + _ODD), 1, 0, None
    while True:
        if length & size:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * _ODD + part)
            done += size
        if 2 * size > length:
            return out
        power = mix(power[:-size] * _PLACE + power[size:])
        size *= 2


def byte_run_hash(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` successive bytes (len(data) - length + 1 of them)."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    view = eights(data)
    if length < 8:
        return mix((view[:n] << U64(8 * (8 - length))) + U64(length))
    out = mix(view[:n] + U64(length))
    for at in [*range(8, length - 7, 8), length - 8][: (length - 1) // 8]:
        out = mix(out * _ODD + view[at : at + n])
    return out


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` successive hashes the place of its smallest, the first of equals.

    Only the upper 32 bits rank, the lower 32 hold the place: equal windows choose the same
    place wherever they stand.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    pad = -n % width
    keys = np.full(n + pad, np.iinfo(U64).max, U64)
    keys[:n] = (hashes & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    grid = keys.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (low & U64(0xFFFFFFFF)).astype(np.int64)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for every i."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. of lengths[0] numbers, then those of the next start, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    return base + np.arange(total)
