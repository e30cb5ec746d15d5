"""Repeated windows by super-k-mer partitioning: what substring and suffix-array dedup share.

Every window of a text has a minimiser, the smallest-hashed run of ``m`` symbols inside it.
Consecutive windows with the same minimiser occurrence make a super-k-mer; equal windows have
equal minimisers, so a super-k-mer travels as one packed string to its minimiser's bucket and
all equal windows meet there.

Skew: before the shuffle each task keeps, of equal super-k-mers in ``FLUSH_BYTES`` of them, only
what the smallest document holds, and marks the rest as repeated there and then.  A string that
a third of all rows share so reaches its bucket once for each flush, not once for each row.
Equal hashes are never enough for that: the strings themselves are compared.

A minimiser that many different strings share is found by a count over all texts.  Windows around
it go by the minimiser and half of what is beside it, to the one or the other side: equal windows
have the same half on the same side, so they still meet, and a common word or phrase no longer
brings all its surroundings into one bucket.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

#: Raw bytes of super-k-mers that a task gathers before it packs them by bucket.
FLUSH_BYTES = 24 << 20
#: Raw bytes of a bucket, on the average, and buckets of a partition.
BUCKET_BYTES, BUCKETS_EACH = 5 << 20, 4
#: Raw bytes of super-k-mers for each byte of text.
GROWTH = 3.3
#: Minimisers are counted in so many bins; those of a bin with HOT times the average's or a bucket's bytes are split.
BINS, HOT = 1 << 14, 4
MAX_ID = (1 << 63) - 1
SPANS = "_id long, _fp long, begin long, stop long"
#: doc_id, fingerprint, place of the first window in the document, windows, place of the minimiser, bytes
FIELDS = ("<i8", "<i8", "<i8", "<i4", "<i4", "<i4")


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as planes of their bytes, which pack better than the numbers."""
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: memoryview, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def keyed(docs: DataFrame, id_col: str, text_col: str, apart: bool = True) -> DataFrame:
    """_id (null: the largest), _fp and the text.  _fp keeps rows that share an id apart; without any it is 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("_id"), (F.xxhash64(text) if apart else F.lit(0).cast("long")).alias("_fp"), text.alias("_text"))


def measure(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, int, bool]:
    """Partitions and buckets, so many that a bucket's size doesn't depend on the input's, and whether ids repeat."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col))), F.count(F.lit(1)), F.count_distinct(F.col(id_col))).first()
    total = row[0] or 0
    parts = max(int(total * GROWTH / (BUCKET_BYTES * BUCKETS_EACH)), least_partitions(docs.sparkSession, total))
    return parts, parts * BUCKETS_EACH, row[1] != row[2]


def least_partitions(spark: SparkSession, total: int) -> int:
    """As many partitions as the session asks for, fewer for texts that wouldn't give each a quarter of a megabyte."""
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (256 << 10))
    return max(spark.sparkContext.defaultParallelism, wanted)


class Packed:
    """Super-k-mers: one array for each of FIELDS, and the strings' bytes one after another."""

    def __init__(self, fields: list[np.ndarray], raw: np.ndarray):
        self.fields, self.raw = fields, raw

    @staticmethod
    def join(parts: list[Packed]) -> Packed:
        return Packed([np.concatenate([p.fields[k] for p in parts]) for k in range(len(FIELDS))], np.concatenate([p.raw for p in parts]))

    def take(self, chosen: np.ndarray) -> Packed:
        sizes = self.fields[5].astype(np.int64)
        at = np.cumsum(sizes) - sizes
        return Packed([f[chosen] for f in self.fields], self.raw[textkit.ranges(at[chosen], sizes[chosen])])

    @staticmethod
    def write(fields: list[np.ndarray], strings: bytes) -> bytes:
        n = len(fields[0])
        changed = [np.diff(fields[0], prepend=0), *fields[1:5], fields[5] - fields[3]]
        parts = [np.array([n], "<i8").tobytes(), *(_planes(f, t) for f, t in zip(changed, FIELDS, strict=True)), strings]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))

    @staticmethod
    def read(blob: bytes) -> Packed:
        data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        n, at, fields = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
        for t in FIELDS:
            fields.append(_unplanes(data[at:], t, n))
            at += n * np.dtype(t).itemsize
        fields[0] = np.cumsum(fields[0])
        fields[5] = fields[5] + fields[3]
        return Packed(fields, np.frombuffer(data, np.uint8, offset=at))


def super_kmers(minis: np.ndarray, first: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, place of the minimiser, its hash) of each super-k-mer; minis hashes each m-run."""
    low = textkit.sliding_argmin(minis, window - m + 1)
    windows = np.maximum(0, np.diff(first) - window + 1)
    start = textkit.ranges(first[:-1], windows)
    mini = low[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (mini[1:] != mini[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(cut)
    count = np.diff(np.r_[begin, len(start)])
    a = start[begin]
    return np.searchsorted(first, a, "right") - 1, a, count, mini[begin], minis[mini[begin]] if len(begin) else np.zeros(0, np.uint64)


def split_hot(kmers: tuple[np.ndarray, ...], hot: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, m: int) -> tuple[np.ndarray, ...]:
    """The super-k-mers, those with minimisers of a hot bin cut in two, with a key that takes in half of one side."""
    doc, a, count, mini, key = kmers
    some = hot[(key >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)]
    if not some.any():
        return kmers
    half = (window - m) // 2
    whole = [x[~some] for x in kmers]
    doc, a, count, mini = (x[some] for x in (doc, a, count, mini))
    left = np.clip(mini - half + 1 - a, 0, count)  # windows with so much before the minimiser
    parts = [whole]
    for begin, n, low, high, salt in ((a, left, mini - half, mini + m - 1, 1), (a + left, count - left, mini, mini + m + half - 1, 2)):
        own = np.flatnonzero(n)
        code = textkit.span_hash(data, starts[low[own]], ends[high[own]])
        parts.append([doc[own], begin[own], n[own], mini[own], textkit.mix(code + np.uint64(salt))])
    out = [np.concatenate([p[k] for p in parts]) for k in range(5)]
    order = np.argsort(out[1], kind="stable")
    return tuple(x[order] for x in out)


def first_of_equal(keys: list[np.ndarray], order_by: list[np.ndarray]) -> np.ndarray:
    """For every row the place of the first row, in the given order, with the same keys."""
    n = len(keys[0])
    order = np.lexsort([*reversed(order_by), *reversed(keys)])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out = np.empty(n, np.int64)
    out[order] = order[lead]
    return out


def repeated_spans(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    window: int,
    m: int,
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]],
    judge: Callable[[Packed], tuple[np.ndarray, np.ndarray, np.ndarray]],
    within_document: bool,
) -> DataFrame:
    """(_id, _fp, begin, stop) of runs of symbols that repeated windows cover.

    ``split(bytes, offsets)`` gives the bytes that stand for the symbols, where each symbol starts
    and ends in them, each document's first symbol, and a hash of each run of ``m`` symbols; equal
    runs of symbols must be equal bytes.  ``judge`` gets a bucket and returns rows, first and last
    flagged window of each flagged run.  ``within_document``: a window that stands earlier in the
    same document repeats as well.
    """
    parts, buckets, apart = measure(docs, id_col, text_col)
    texts_of = keyed(docs, id_col, text_col, apart)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for _, offs, data in textkit.slices(batches, "_text"):
            _, starts, ends, first, minis = split(data, offs)
            _, a, count, _, mini_hash = super_kmers(minis, first, window, m)
            if len(a):
                size = ends[a + count + window - 2] - starts[a]
                total += np.bincount((mini_hash >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), size, BINS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bin", "size"])

    bins = texts_of.select("_text").mapInArrow(weigh, "bin int, size long").groupBy("bin").agg(F.sum("size").alias("size")).collect()  # BINS rows at most
    limit = HOT * max(BUCKET_BYTES, sum(r["size"] for r in bins) // BINS)
    hot = np.zeros(BINS, bool)
    hot[[r["bin"] for r in bins if r["size"] > limit]] = True

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            raw = b"".join(texts)
            ids, fps, place, count, mini, begin, stop, own, key = (np.concatenate([h[k] for h in held]) for k in range(9))
            texts.clear(), held.clear()
            lead = first_of_equal([own, stop - begin, mini], [ids, fps, place])
            again = lead != np.arange(len(lead)) if within_document else ids[lead] < ids
            k = np.flatnonzero(again)
            again[k] = textkit.equal_spans(np.frombuffer(raw, np.uint8), begin[k], begin[lead[k]], (stop - begin)[k])
            if again.any():
                # their spans take the same way, as super-k-mers without text and with a negative count;
                # those that follow each other in a document are one
                k = np.flatnonzero(again)
                joins = (np.diff(k) == 1) & (ids[k[1:]] == ids[k[:-1]]) & (fps[k[1:]] == fps[k[:-1]]) & (place[k[1:]] == (place + count)[k[:-1]])
                k = k[np.r_[True, ~joins]]
                run = np.add.reduceat(np.where(again, count, 0), k)
                none = np.zeros(len(k), np.int64)
                yield rows([ids[k], fps[k], place[k], -run, none, none], textkit.mix((ids[k] ^ fps[k]).astype(np.uint64)) % np.uint64(buckets))
            k = np.flatnonzero(~again)
            yield rows([ids[k], fps[k], place[k], count[k], mini[k], (stop - begin)[k]], textkit.mix(key[k]) % np.uint64(buckets), raw, begin[k], stop[k])

        def rows(fields: list[np.ndarray], bucket: np.ndarray, raw: bytes = b"", begin: np.ndarray | None = None, stop: np.ndarray | None = None) -> pa.RecordBatch:
            order = np.argsort(bucket, kind="stable")
            bucket, fields = bucket[order], [f[order] for f in fields]
            spans = list(zip(begin[order].tolist(), stop[order].tolist(), strict=True)) if begin is not None else []
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(bucket) else []
            blobs = [Packed.write([f[a:b] for f in fields], b"".join([raw[x:y] for x, y in spans[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        size = base = 0
        for batch, offs, data in textkit.slices(batches, "_text"):
            data, starts, ends, first, minis = split(data, offs)
            doc, a, count, mini, key = split_hot(super_kmers(minis, first, window, m), hot, data, starts, ends, window, m)
            if not len(doc):
                continue
            ids, fps = (np.asarray(batch.column(k))[doc] for k in (0, 1))
            begin, stop = starts[a], ends[a + count + window - 2]
            texts.append(data.tobytes())
            held.append((ids, fps, a - first[doc], count, mini - a, begin + base, stop + base, textkit.span_hash(data, begin, stop), key))
            base += len(data)
            size += int((stop - begin).sum())
            if size >= FLUSH_BYTES:
                yield from flush()
                size = base = 0
        if held:
            yield from flush()

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blobs[bucket].append(blob)
        while blobs:
            got = Packed.join([Packed.read(b) for b in blobs.popitem()[1]])
            ids, fps, place, count, *_ = got.fields
            known = count < 0
            out = [(ids[known], fps[known], place[known], place[known] - count[known] + window - 1)]
            if not known.all():
                got = got.take(np.flatnonzero(~known)) if known.any() else got
                row, begin, last = judge(got)
                ids, fps, place, *_ = got.fields
                out.append((ids[row], fps[row], place[row] + begin, place[row] + last + window))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(4)], ["_id", "_fp", "begin", "stop"])

    packed = texts_of.mapInArrow(pack, "bucket long, blob binary")
    return packed.repartition(parts, "bucket").mapInArrow(sort_out, SPANS)


def flagged_runs(flag: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place (from the row's first) of each run of true flags that doesn't cross rows."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    on = np.flatnonzero(flag)
    if not len(on):
        return (np.zeros(0, np.int64),) * 3
    cut = np.r_[True, (np.diff(on) != 1) | (row[on[1:]] != row[on[:-1]])]
    begin = on[cut]
    last = on[np.r_[cut[1:], True]]
    return row[begin], begin - first[row[begin]], last - first[row[begin]]


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row of ``docs`` (id and text) with the begins and stops of its own spans, null if it has none."""
    per_row = spans.groupBy("_id", "_fp").agg(F.collect_list(F.struct("begin", "stop")).alias("_spans"))
    per_row = per_row.select(F.col("_id").alias("_own"), "_fp", F.col("_spans.begin").alias("_begins"), F.col("_spans.stop").alias("_stops"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("_id"), text.alias("_text"))
    mine = (F.col("_id") == F.col("_own")) & ((F.col("_fp") == 0) | (F.col("_fp") == F.xxhash64("_text")))
    return rows.join(per_row, mine, "left").select("_doc", "_text", "_begins", "_stops")


def merged(begins: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover, in order; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begins, stops, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
