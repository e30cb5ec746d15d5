"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their hashes.  It is cut into equal ranges, the
fragments, and every document's set falls apart into one segment for each fragment.  A fragment
counts overlaps of its segments alone; the partial counts of a document or pair are summed over
the fragments.  Three such counts find the components of all links:

1. per document, the n-grams that any other document has.  A linked document shares at least
   the threshold's part of its set, so the others are done; of the rest only n-grams that
   others have go on.
2. per document and leader.  The leader of an n-gram is its most central holder; a star of
   (holder, leader) pairs stands for all pairs of the holders.  The sum is a lower bound of the
   pair's overlap, so what reaches the threshold is a link.
3. per pair of documents in different components so far, of those documents that share the
   threshold's part of their sets with other components.  These sums are the exact overlaps,
   which complete the links.  Pairs inside a component need no count: they can't change it.
   Before that, a document must have enough parts of its set in common, part for part, with
   other components (see ``_parts_of``): documents made of common passages in ever new
   combinations, which would meet nearly all others, are done by then.

Documents with equal sets are one, in a flush of a task before the first shuffle and in every
fragment after it.  Segments and partial counts travel packed, one row for each pair of task and
bucket, so that the number of fragments, which grows with the input, costs no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import components, written
from .windows import MAX_ID, _planes, _unplanes, first_of_equal, keyed, least_partitions, measure

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
FLUSH_GRAMS = 1_000_000
#: N-grams of a fragment on the average, at one for each WORD_BYTES of text.
FRAGMENT_GRAMS, WORD_BYTES = 2_000_000, 5.5
PACKED = "bucket int, blob binary"
DOCUMENT = "_id long, _fp long, n int, sum1 long, sum2 long, rank double, grams binary"


def shingle_sets(data: np.ndarray, offs: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct n-grams, ascending, and each document's first (n + 1)."""
    low = textkit.LOWER[data]
    starts, ends, first = textkit.word_bounds(low, offs)
    words = textkit.span_hash(low, starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), np.maximum(count - words_each + 1, 0))
    grams = textkit.rolling_hash(words, words_each)[textkit.ranges(first[:-1], np.maximum(count - words_each + 1, 0))]
    brief = np.flatnonzero((count > 0) & (count < words_each))
    if len(brief):
        total = np.zeros(len(brief), np.uint64)
        for k in range(words_each - 1):
            some = count[brief] > k
            total[some] = textkit.mix(total[some] * np.uint64(3) + words[first[brief[some]] + k] + np.uint64(k + 1))
        owner, grams = np.r_[owner, brief], np.r_[grams, textkit.mix(total + count[brief].astype(np.uint64))]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], np.searchsorted(owner[keep], np.arange(len(count) + 1))


def _six(grams: np.ndarray) -> bytes:
    """The lower 48 bits of each n-gram; with its fragment they tell it apart."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(raw: bytes | memoryview) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _write(columns: list[np.ndarray], grams: np.ndarray | None = None, tag: int = 0) -> bytes:
    """Columns of whole numbers, the first as steps, and n-grams, packed."""
    head = np.array([tag, len(columns), len(columns[0]) if columns else 0], "<i8").tobytes()
    body = [_planes(np.diff(c, prepend=0) if k == 0 else c, "<i8") for k, c in enumerate(columns)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *body, _six(grams) if grams is not None else b""]))


def _read(blob: bytes) -> tuple[int, list[np.ndarray], np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    tag, width, n = np.frombuffer(data, "<i8", 3).tolist()
    columns = [_unplanes(data[24 + 8 * n * k :], "<i8", n) for k in range(width)]
    if columns:
        columns[0] = np.cumsum(columns[0])
    return tag, columns, _unsix(data[24 + 8 * n * width :])


def _rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    held: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[bucket].append(blob)
    while held:
        yield held.popitem()


def _scatter(bucket: np.ndarray, buckets: int, columns: list[np.ndarray], tag: int, grams: np.ndarray | None = None, first: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows packed by bucket; row k has the n-grams from first[k] to first[k + 1]."""
    order = np.lexsort((columns[0], bucket))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    names, blobs = [], []
    for k in range(buckets):
        own = order[bounds[k] : bounds[k + 1]]
        if len(own):
            names.append(k)
            mine = None if grams is None else grams[textkit.ranges(first[own], first[own + 1] - first[own])]
            blobs.append(_write([c[own] for c in columns], mine, tag))
    return _rows(names, blobs)


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return (textkit.mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


SETS, SEGMENTS, COUNTS = 0, 1, 2


def _to_fragments(ids: np.ndarray, extra: list[np.ndarray], first: np.ndarray, grams: np.ndarray, part: np.ndarray, fragments: int) -> Iterator[pa.RecordBatch]:
    """The documents' segments, packed by fragment, each with its document's columns and its size."""
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    order = np.lexsort((owner, part))
    part, owner, grams = part[order], owner[order], grams[order]
    bounds = np.searchsorted(part, np.arange(fragments + 1))
    names, blobs = [], []
    for k in range(fragments):
        a, e = bounds[k], bounds[k + 1]
        if a < e:
            who, times = np.unique(owner[a:e], return_counts=True)
            names.append(k)
            blobs.append(_write([ids[who], *(x[who] for x in extra), times], grams[a:e], SEGMENTS))
    yield _rows(names, blobs)


def _documents(docs: DataFrame, id_col: str, text_col: str, words_each: int, percent: int) -> tuple[DataFrame, int]:
    """(rows of DOCUMENT, fragments): grams holds, of documents that others may be linked with, fragment and n-gram of
    what other documents have too, else null."""
    _, _, apart = measure(docs, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(least_partitions(docs.sparkSession, total), int(total / WORD_BYTES / FRAGMENT_GRAMS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, fps, sizes, grams = (np.concatenate([h[k] for h in held]) for k in range(4))
            held.clear()
            first = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=first[1:])
            sums = []
            for values in (grams, textkit.mix(grams)):
                total = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(values, out=total[1:])
                sums.append((total[first[1:]] - total[first[:-1]]).astype(np.int64))
            # sizes and segments share a shuffle; a document's bucket has the number of a fragment
            yield _scatter(_home(ids, parts), parts, [ids, fps, sizes, *sums], SETS)
            own = np.flatnonzero((first_of_equal([sizes, *sums], [ids, fps]) == np.arange(len(ids))) & (sizes > 0))
            grams = grams[textkit.ranges(first[own], sizes[own])]
            bounds = np.r_[0, np.cumsum(sizes[own])]
            part = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            yield from _to_fragments(ids[own], [fps[own]], bounds, grams, part, parts)

        size = 0
        for batch, offs, data in textkit.slices(batches, "_text"):
            grams, first = shingle_sets(data, offs, words_each)
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.diff(first), grams))
            size += len(grams)
            if size >= FLUSH_GRAMS:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, blobs in _by_bucket(batches):
            held = []
            for blob in blobs:
                tag, columns, grams = _read(blob)
                if tag == SETS:  # on their way to their documents' bucket, which has this number too
                    yield _rows([fragment], [blob])
                else:
                    held.append((*columns, grams))
            if not held:
                continue
            ids, fps, times, grams = (np.concatenate([h[k] for h in held]) for k in range(4))
            del held
            df = np.empty(len(grams), np.int32)
            for part in range(8):  # an eighth of the n-grams at a time: sorting takes little memory
                some = np.flatnonzero(grams & np.uint64(7) == part)
                order = np.argsort(grams[some])
                ranked = grams[some[order]]
                begin = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(some) else some
                holders = np.diff(np.r_[begin, len(some)])
                df[some[order]] = np.repeat(holders, holders)
            shared = np.flatnonzero(df > 1)
            owner = np.searchsorted(np.cumsum(times), shared, "right")
            grams, df = grams[shared], df[shared]
            first = np.searchsorted(owner, np.arange(len(ids) + 1))
            some = np.flatnonzero(np.diff(first))
            weight = textkit.segment_sum(df, first)
            bounds = np.r_[first[some], len(grams)]
            yield _scatter(_home(ids[some], parts), parts, [ids[some], fps[some], np.full(len(some), fragment), weight[some], np.diff(first)[some]], SEGMENTS, grams, bounds)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            sets, segments, grams = [], [], []
            for blob in blobs:
                tag, columns, own = _read(blob)
                if tag == SETS:
                    sets.append(columns)
                else:
                    segments.append(columns)
                    grams.append(own)
            ids, fps, sizes, sum1, sum2 = (np.concatenate([c[k] for c in sets]) for k in range(5))
            order = np.lexsort((fps, ids))
            ids, fps, sizes, sum1, sum2 = (x[order] for x in (ids, fps, sizes, sum1, sum2))
            rank, packed = np.zeros(len(ids)), [None] * len(ids)
            if segments:
                sid, sfp, fragment, weight, times = (np.concatenate([c[k] for c in segments]) for k in range(5))
                own = np.concatenate(grams)
                first = np.r_[0, np.cumsum(times)]
                order = np.lexsort((sfp, sid))
                cut_at = np.flatnonzero(np.r_[True, (np.diff(sid[order]) != 0) | (np.diff(sfp[order]) != 0)])
                # rows that repeat id and text have one set; the first of them stands for all
                place = {(i, f): k for k, (i, f) in reversed(list(enumerate(zip(ids.tolist(), fps.tolist(), strict=True))))}
                for a, e in zip(cut_at.tolist(), [*cut_at[1:].tolist(), len(order)], strict=True):
                    k = place[int(sid[order[a]]), int(sfp[order[a]])]
                    some = order[a:e]
                    if 100 * int(times[some].sum()) >= percent * int(sizes[k]):
                        mine = own[textkit.ranges(first[some], times[some])]
                        where = np.repeat(fragment[some], times[some])
                        rank[k] = float(weight[some].sum()) / float(sizes[k])
                        packed[k] = where.astype("<i4").tobytes() + _six(mine)
            for a in range(0, len(ids), 5_000):
                e = a + 5_000
                yield pa.RecordBatch.from_arrays([pa.array(x[a:e]).cast(t) for x, t in ((ids, pa.int64()), (fps, pa.int64()), (sizes, pa.int32()), (sum1, pa.int64()), (sum2, pa.int64()), (rank, pa.float64()))] + [pa.array(packed[a:e], pa.binary())], ["_id", "_fp", "n", "sum1", "sum2", "rank", "grams"])

    packed = keyed(docs, id_col, text_col, apart).mapInArrow(cut, PACKED).repartition(parts, "bucket").mapInArrow(share, PACKED)
    return packed.repartition(parts, "bucket").mapInArrow(gather, DOCUMENT), parts


def _cut_rows(extra: list[str], fragments: int):
    """Document rows to packed segments with these columns besides _id."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                rows = batch.slice(at, 2_000)
                named = {c: np.asarray(rows.column(k)) for k, c in enumerate(rows.schema.names) if c != "grams"}
                raw = rows.column(rows.schema.get_field_index("grams")).to_pylist()
                sizes = np.array([len(r) // 10 for r in raw], np.int64)
                part = np.concatenate([np.frombuffer(r, "<i4", len(r) // 10) for r in raw]).astype(np.int64)
                grams = np.concatenate([_unsix(r[len(r) // 10 * 4 :]) for r in raw])
                yield from _to_fragments(named["_id"], [named[c] for c in extra], np.r_[0, np.cumsum(sizes)], grams, part, fragments)

    return kernel


def _fragments(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """For each fragment the documents' columns, and its n-grams with the place of their document; equal sets once."""
    for _, blobs in _by_bucket(batches):
        read = [_read(b) for b in blobs]
        columns = [np.concatenate([c[k] for _, c, _ in read]) for k in range(len(names) + 1)]
        docs, times = dict(zip(names, columns, strict=False)), columns[-1]
        grams = np.concatenate([g for *_, g in read])
        del read
        first = np.r_[0, np.cumsum(times)]
        if "sum1" in docs:
            keep = np.flatnonzero(first_of_equal([docs["sum1"], docs["n"], times, grams[first[:-1]]], [docs["_id"], docs["_fp"]]) == np.arange(len(times)))
            grams = grams[textkit.ranges(first[keep], times[keep])]
            docs, times = {k: v[keep] for k, v in docs.items()}, times[keep]
        yield docs, grams, np.repeat(np.arange(len(times)), times)


def _stars(homes: int):
    names = ["_id", "_fp", "n", "sum1", "rank"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, grams, owner in _fragments(batches, names):
            lead = owner[first_of_equal([grams], [-docs["rank"][owner], docs["_id"][owner], docs["_fp"][owner]])]
            some = lead != owner
            total = len(docs["n"])
            keys, times = np.unique(owner[some] * total + lead[some], return_counts=True)
            one, two = keys // total, keys % total
            yield _scatter(_home(docs["_id"][one], homes), homes, [docs["_id"][one], docs["_fp"][one], docs["n"][one], docs["_id"][two], docs["_fp"][two], docs["n"][two], times], COUNTS)

    return kernel


PAIR = "a long, fa long, na int, b long, fb long, nb int, overlap long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed partial counts of pairs to their sums."""
    for _, blobs in _by_bucket(batches):
        read = [_read(b)[1] for b in blobs]
        a, fa, na, b, fb, nb, times = (np.concatenate([c[k] for c in read]) for k in range(7))
        order = np.lexsort((fb, b, fa, a))
        a, fa, na, b, fb, nb, times = (x[order] for x in (a, fa, na, b, fb, nb, times))
        begin = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(fa) != 0) | (np.diff(b) != 0) | (np.diff(fb) != 0)]) if len(a) else np.zeros(0, np.int64)
        overlap = np.add.reduceat(times, begin) if len(begin) else times
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip((*(x[begin] for x in (a, fa, na, b, fb, nb)), overlap), kinds, strict=True)], [x.split()[0] for x in PAIR.split(", ")])


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(F.expr(f"100 * overlap >= {percent} * (na + nb - overlap)")).select("a", "b")


def _unsettled(near: DataFrame, pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(_open, _open_fp) of documents that may have links to other components.

    A document and its leader in one component settle the n-grams between them unless the leader
    has a holder elsewhere.  What isn't settled, and what the document leads itself if it has a
    holder elsewhere, must be the threshold's part of its set.  Two documents of different
    components that are linked both pass: of each n-gram they share one of them is elsewhere
    than its leader.
    """
    component = found.select(F.col("node"), F.col("component"))
    one, two = component.toDF("_na", "_ca"), component.toDF("_nb", "_cb")
    placed = pairs.join(one, F.col("a") == F.col("_na"), "left").join(two, F.col("b") == F.col("_nb"), "left")
    apart = F.coalesce("_ca", "a") != F.coalesce("_cb", "b")
    placed = placed.select("a", "fa", "b", "fb", "overlap", apart.alias("apart"))
    leaders = placed.where("apart").select(F.col("b").alias("_lb"), F.col("fb").alias("_lf")).distinct()
    marked = placed.join(leaders, (F.col("b") == F.col("_lb")) & (F.col("fb") == F.col("_lf")), "left")
    loose = F.sum(F.when(F.col("apart") | F.col("_lb").isNotNull(), F.col("overlap")).otherwise(0))
    sums = marked.groupBy("a", "fa").agg(loose.alias("loose"), F.sum("overlap").alias("led_by_others"))
    docs = near.select("_id", "_fp", "n").join(sums, (F.col("_id") == F.col("a")) & (F.col("_fp") == F.col("fa")), "left")
    docs = docs.join(leaders, (F.col("_id") == F.col("_lb")) & (F.col("_fp") == F.col("_lf")), "left")
    own = F.when(F.col("_lb").isNotNull(), F.col("n") - F.coalesce("led_by_others", F.lit(0))).otherwise(0)
    return docs.where(100 * (F.coalesce("loose", F.lit(0)) + own) >= percent * F.col("n")).select(F.col("_id").alias("_open"), F.col("_fp").alias("_open_fp"))


def _foreign(homes: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, grams, owner in _fragments(batches, ["_id", "_fp", "n", "sum1", "component"]):
            component = docs["component"][owner]
            order = np.lexsort((component, grams))
            g, c = grams[order], component[order]
            begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[begin, len(g)])
            several = np.empty(len(g), bool)
            several[order] = np.repeat(c[begin] != c[begin + size - 1], size)
            count = np.bincount(owner[several], minlength=len(docs["n"]))
            some = np.flatnonzero(count)
            yield _scatter(_home(docs["_id"][some], homes), homes, [docs["_id"][some], docs["_fp"][some], docs["n"][some], count[some]], COUNTS)

    return kernel


def _levels(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of set sizes: the largest size of each, how many n-grams linked sets up to it may differ by, and its parts.

    Sets that are linked are of one level or of neighbours.
    """
    top, differ = [0], [0]
    while top[-1] < largest:
        top.append((top[-1] + 1) * 100 // percent)
        differ.append(2 * top[-1] * (100 - percent) // (100 + percent))
    top.append((top[-1] + 1) * 100 // percent)
    differ.append(2 * top[-1] * (100 - percent) // (100 + percent))
    return np.array(top, np.int64), np.array(differ, np.int64), (np.array(differ, np.int64) + 1) * 3 // 2


def _parts_of(percent: int, fragments: int):
    """Document rows to rows whose grams are hashes of the set's parts, and whose n is how many of them must be shared.

    A level's n-grams are cut at random into its parts, half as many again as n-grams that two
    linked sets may differ by.  As a difference spoils one part, all but that number of a set's
    parts that aren't empty are the same in a linked set.  Sets go by the parts of their own level and
    of the next, where smaller and larger partners are.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                rows = batch.slice(at, 2_000)
                n = np.asarray(rows.column(rows.schema.get_field_index("n"))).astype(np.int64)
                raw = rows.column(rows.schema.get_field_index("grams")).to_pylist()
                owner = np.repeat(np.arange(len(raw)), [len(r) // 10 for r in raw])
                where = np.concatenate([np.frombuffer(r, "<i4", len(r) // 10) for r in raw]).astype(np.uint64)
                keys = textkit.mix(np.concatenate([_unsix(r[len(r) // 10 * 4 :]) for r in raw]) + textkit.mix(where))
                top, differ, parts = _levels(int(n.max()), percent)
                need, found, of = np.full(len(raw), 1 << 30), [], []
                for level in (np.searchsorted(top, n), np.searchsorted(top, n) + 1):
                    count = parts[level]
                    first = np.cumsum(count) - count
                    part = ((keys >> np.uint64(32)) * count[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                    place = first[owner] + part
                    held, sums = np.bincount(place, minlength=int(count.sum())), np.zeros(int(count.sum()), np.uint64)
                    np.add.at(sums, place, textkit.mix(keys))
                    some = np.flatnonzero(held)
                    doc = np.searchsorted(first, some, "right") - 1
                    found.append(textkit.mix(sums[some] + textkit.mix((level[doc] * (1 << 40) + some - first[doc]).astype(np.uint64))))
                    of.append(doc)
                    need = np.minimum(need, np.bincount(doc, minlength=len(raw)) - differ[level])
                found, of = np.concatenate(found), np.concatenate(of)
                order = np.argsort(of, kind="stable")
                found, bounds = found[order], np.searchsorted(of[order], np.arange(len(raw) + 1)).tolist()
                home = ((found >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype("<i4")
                packed = [home[a:e].tobytes() + _six(found[a:e]) for a, e in zip(bounds[:-1], bounds[1:], strict=True)]
                named = [rows.column(rows.schema.get_field_index(c)) for c in ("_id", "_fp", "sum1", "component")]
                yield pa.RecordBatch.from_arrays([*named[:2], pa.array(need).cast(pa.int32()), *named[2:], pa.array(packed, pa.binary())], ["_id", "_fp", "n", "sum1", "component", "grams"])

    return kernel


def _open(percent: int):
    """Packed partial counts of documents to those that reach the threshold's part."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            read = [_read(b)[1] for b in blobs]
            ids, fps, n, count = (np.concatenate([c[k] for c in read]) for k in range(4))
            order = np.lexsort((fps, ids))
            ids, fps, n, count = (x[order] for x in (ids, fps, n, count))
            begin = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(fps) != 0)]) if len(ids) else np.zeros(0, np.int64)
            total = np.add.reduceat(count, begin) if len(begin) else count
            good = 100 * total >= percent * n[begin]
            yield pa.RecordBatch.from_arrays([pa.array(ids[begin][good]), pa.array(fps[begin][good]), pa.array(total[good]).cast(pa.int64())], ["_open", "_open_fp", "foreign"])

    return kernel


#: Meetings that are counted at once, counts that may be held for them, and pairs of an exchange's batch.
STRIPE_MEETINGS, DENSE_COUNTS, BATCH_PAIRS = 4_000_000, 16_000_000, 1_000_000


def _stripes(grams: np.ndarray, owner: np.ndarray, total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(one, two, n-grams both have) of pairs of documents one < two, some documents ``one`` at a time."""
    order = np.lexsort((owner, grams))
    g, who = grams[order], owner[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(g)])
    ahead = np.repeat(begin + size, size) - np.arange(len(g)) - 1
    entry = np.argsort(who, kind="stable")
    entry = entry[ahead[entry] > 0]
    first = np.searchsorted(who[entry], np.arange(total + 1))
    bound = np.r_[0, np.cumsum(ahead[entry])][first]
    a = 0
    while a < total:
        e = max(a + 1, int(np.searchsorted(bound, bound[a] + STRIPE_MEETINGS, "right")) - 1)
        own = entry[first[a] : first[e]]
        if len(own):
            key = np.repeat(who[own] - a, ahead[own]) * total + who[textkit.ranges(own + 1, ahead[own])]
            if (e - a) * total <= min(DENSE_COUNTS, 8 * len(key)):  # many meetings of few documents: a count for each pair
                count = np.bincount(key)
                met = np.flatnonzero(count)
                count = count[met]
            else:
                met, count = np.unique(key, return_counts=True)
            yield met // total + a, met % total, count
        a = e


def _across(percent: int, homes: int):
    names = ["_id", "_fp", "n"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, grams, owner in _fragments(batches, ["_id", "_fp", "n", "sum1", "component", "foreign"]):
            held: list[tuple[np.ndarray, ...]] = []

            def flush(docs: dict = docs, held: list = held) -> pa.RecordBatch:
                one, two, n = (np.concatenate([h[k] for h in held]) for k in range(3))
                held.clear()
                # the pair's order is that of (id, fp), so that all fragments name it alike
                swap = (docs["_id"][one] > docs["_id"][two]) | ((docs["_id"][one] == docs["_id"][two]) & (docs["_fp"][one] > docs["_fp"][two]))
                one, two = np.where(swap, two, one), np.where(swap, one, two)
                return _scatter(_home(docs["_id"][one], homes), homes, [*(docs[c][one] for c in names), *(docs[c][two] for c in names), n], COUNTS)

            for one, two, n in _stripes(grams, owner, len(docs["n"])):
                # an overlap exceeds neither what one shares with other components nor the smaller set
                most, sizes = np.minimum(docs["foreign"][one], docs["foreign"][two]), docs["n"][one] + docs["n"][two]
                good = (docs["component"][one] != docs["component"][two]) & (100 * most >= percent * (sizes - most))
                held.append((one[good], two[good], n[good]))
                if sum(len(h[0]) for h in held) >= BATCH_PAIRS:
                    yield flush()
            if held:
                yield flush()

    return kernel


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row; ids are integers.

    A text with fewer words than an n-gram has one n-gram, its whole sequence.  A null text, or
    one without words, has the empty set and links with nothing.  Rows that share an id are one
    vertex, with a set each; rows without an id are one vertex too, after all others, whose
    component is null if it reaches no other.  Other columns are ignored.

    N-grams are told apart by 48 bits of hash and their fragment: an overlap of two documents
    can be wrong only if two different n-grams of these very documents collide.
    """
    rows, parts = _documents(docs, id_col, text_col, words_each, percent)
    rows = written(rows, "sets")
    near = rows.where("grams is not null").withColumn("rank", F.round(F.col("rank") * 1000).cast("long"))

    def counted(source: DataFrame, columns: list[str], count, add, schema: str) -> DataFrame:
        cut = source.select("_id", *columns, "grams").mapInArrow(_cut_rows(columns, parts), PACKED).repartition(parts, "bucket")
        return cut.mapInArrow(count, PACKED).repartition(parts, "bucket").mapInArrow(add, schema)

    equal = rows.where("n > 0").groupBy("sum1", "sum2", "n").agg(F.min("_id").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # the further key makes both sides of the join shuffle anew, so that Spark can split a set that many rows share
    equal = equal.withColumn("_key", F.xxhash64("sum1", "sum2", "n"))
    same = rows.select("_id", "sum1", "sum2", "n", F.xxhash64("sum1", "sum2", "n").alias("_key")).join(equal, ["sum1", "sum2", "n", "_key"]).where("_id > b").select(F.col("_id").alias("a"), "b")
    pairs = written(counted(near, ["_fp", "n", "sum1", "rank"], _stars(parts), _sums, PAIR), "pairs")
    found = components(written(_linked(pairs, percent).union(same), "links"))
    loose = written(_unsettled(near, pairs, found, percent), "unsettled")
    if not loose.isEmpty():
        mine = (F.col("_id") == F.col("_open")) & (F.col("_fp") == F.col("_open_fp"))
        placed = near.join(loose, mine, "left_semi").join(found.withColumnRenamed("node", "_node"), F.col("_id") == F.col("_node"), "left")
        placed = written(placed.select("_id", "_fp", "n", "sum1", F.coalesce("component", "_id").alias("component"), "grams"), "placed")
        columns = ["_fp", "n", "sum1", "component"]
        open_rows = "_open long, _open_fp long, foreign long"
        left = written(placed.join(counted(placed, columns, _foreign(parts), _open(percent), open_rows), mine).drop("_open", "_open_fp"), "open")
        cut = written(left.select("_id", *columns, "grams").mapInArrow(_parts_of(percent, parts), "_id long, _fp long, n int, sum1 long, component long, grams binary"), "parts")
        enough = counted(cut.where("n > 0"), columns, _foreign(parts), _open(100), open_rows).select("_open", "_open_fp").union(cut.where("n <= 0").select("_id", "_fp"))
        left = left.join(enough.distinct(), mine, "left_semi")
        more = written(_linked(counted(left, [*columns, "foreign"], _across(percent, parts), _sums, PAIR), percent), "links")
        if not more.isEmpty():
            # the stars found so far and the new links are all that is needed
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    sizes = rows.select("_id", F.col("n").cast("long").alias("n_shingles"))
    named = sizes.join(found.withColumnRenamed("node", "_id"), "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    return named.select(F.when(F.col("_id") < MAX_ID, F.col("_id")).alias(id_col), "n_shingles", F.when(F.col("component") < MAX_ID, F.col("component")).alias("component_id"))
