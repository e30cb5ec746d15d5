"""Importance resampling towards a target distribution of hashed n-grams, by bucket-partitioned inverted postings.

A feature is a run of words, its bucket the crc32 of its bytes modulo the number of buckets.  Each
scan task turns texts into postings (bucket, document, count), packed by shards of buckets, and
into totals of its buckets.  The postings are shuffled to their shard's tasks, the totals of both
corpora are co-grouped with them: sorted before the postings, so that a task has the gains of its
buckets before the first posting streams by, and holds one shard's totals however many postings
follow.  A shard's postings are dealt to several tasks by a hash (a bucket with a third of all
postings is spread like any other), and its totals, which are as large as the shard's buckets, go
to each of them.  What is emitted, (document, contribution), is summed by document.

Ranks of the drawn documents come from counts by score: a score has the rows of higher scores
before it, and rows are only ordered within a score, of which one document in 2,700 shares at most,
as far as the noise goes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .storage import written

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Shards of buckets.
SHARDS = 16
#: Postings, and documents, that are packed together at most (a longer document is packed alone).
FLUSH_POSTINGS = 1 << 20
FLUSH_DOCS = 1 << 14
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 48
#: Scores that are counted together first.
COARSE = 256

#: A-Z to a-z, bytes outside words to a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each byte span."""
    out = np.zeros(len(starts), np.uint32)
    lengths = ends - starts
    raw = data.tobytes() if len(lengths) and lengths.max() > LONG_SPAN else b""
    for k in np.flatnonzero(lengths > LONG_SPAN).tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]])
    short = np.flatnonzero(lengths <= LONG_SPAN)
    order = short[np.argsort(-lengths[short].astype(np.int16), kind="stable")]
    at, left = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
    for k, n in enumerate(live.tolist()):
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def features(data: np.ndarray, offs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and crc32 of every run of 1 to ``longest`` words, and each document's number of words."""
    folded = FOLD[data]
    starts, ends, first = textkit.word_bounds(folded, offs)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    if longest == 1:
        return doc, span_crc32(folded, starts, ends), words
    lengths = ends - starts + 1  # the words, each with one space behind it, one after another
    joined = np.append(folded, np.uint8(32))[textkit.ranges(starts, lengths)]
    begin = np.cumsum(lengths) - lengths
    joined[begin + lengths - 1] = 32
    docs, codes = [], []
    for n in range(1, longest + 1):
        own = np.flatnonzero(np.arange(n - 1, n - 1 + len(doc)) < first[doc + 1])
        docs.append(doc[own])
        codes.append(span_crc32(joined, begin[own], (begin + lengths - 1)[own + n - 1]))
    return np.concatenate(docs), np.concatenate(codes), words


def _packed_type(id_type: str) -> str:
    return f"shard int, kind int, ids array<{id_type}>, words binary, sizes binary, places binary, counts binary, features long"


def _postings(docs: DataFrame, buckets: int, longest: int, target: bool) -> DataFrame:
    """Packed postings (kind 2) and totals (kind 0, of the target corpus 1) by shard; of the target totals only."""
    id_type = dict(docs.dtypes)["_id"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros(buckets, np.int64), 0
        schema = None
        ids: list[pa.Array] = []
        words: list[np.ndarray] = []
        found: list[np.ndarray] = []
        n_docs = n_postings = 0

        def rows(shards: list[int], kind: int, own: pa.Array, parts: list[list[bytes]]) -> pa.RecordBatch:
            n = len(shards)
            same = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(own)), pa.concat_arrays([own] * n))
            columns = [pa.array(shards, pa.int32()), pa.array([kind] * n, pa.int32()), same, *[pa.array(p, pa.binary()) for p in parts], pa.array([seen] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "kind", "ids", "words", "sizes", "places", "counts", "features"])

        def packed() -> pa.RecordBatch:
            key = np.concatenate([k for k, _ in found])
            count = np.concatenate([c for _, c in found])
            shard = (key % buckets % SHARDS).astype(np.uint8)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            parts: list[list[bytes]] = [[], [], [], []]
            for s in range(SHARDS):
                own = order[cut[s] : cut[s + 1]]
                parts[0].append(np.concatenate(words).astype("<i8").tobytes() if s == 0 else b"")
                parts[1].append(np.bincount(key[own] // buckets, minlength=n_docs).astype("<u4").tobytes())
                parts[2].append((key[own] % buckets // SHARDS).astype("<u4").tobytes())
                parts[3].append(count[own].astype("<u4").tobytes())
            return rows(list(range(SHARDS)), 2, pa.concat_arrays(ids), parts)

        for batch, offs, data in textkit.slices(batches, "_text"):
            column = batch.column(batch.schema.get_field_index("_id"))
            schema = column.type
            doc, codes, n_words = features(data, offs, longest)
            bucket = (codes % buckets).astype(np.int64)
            totals += np.bincount(bucket, minlength=buckets)
            seen += len(bucket)
            if target:
                continue
            key = np.sort(doc * buckets + bucket)
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            ids.append(column)
            words.append(n_words)
            found.append((key[new] + n_docs * buckets, np.diff(np.r_[new, len(key)])))
            n_docs, n_postings = n_docs + len(column), n_postings + len(new)
            if n_postings >= FLUSH_POSTINGS or n_docs >= FLUSH_DOCS:
                yield packed()
                ids, words, found, n_docs, n_postings = [], [], [], 0, 0
        if n_docs:
            yield packed()
        if schema is not None:
            empty = [b""] * SHARDS
            yield rows(list(range(SHARDS)), int(target), pa.array([], schema), [empty, empty, empty, [totals[s::SHARDS].astype("<i8").tobytes() for s in range(SHARDS)]])

    return docs.mapInArrow(kernel, _packed_type(id_type))


def _contributions(cogrouped: DataFrame, buckets: int, id_type: str) -> DataFrame:
    """(_id, part, features, words) of each document and shard; each task has one shard, its totals first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = target = gains = None
        seen = [0, 0]
        for batch in batches:
            names = batch.schema.names
            column = {c: batch.column(k) for k, c in enumerate(names)}
            for k in range(batch.num_rows):
                kind = column["kind"][k].as_py()
                counts = column["counts"][k].as_buffer()
                if kind < 2:
                    own = np.frombuffer(counts, "<i8")
                    raw, target = (np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)) if raw is None else (raw, target)
                    (target if kind else raw).__iadd__(own)
                    seen[kind] += column["features"][k].as_py()
                    continue
                if gains is None:
                    s, t = raw.astype(np.float64), target.astype(np.float64)
                    gains = np.floor(1000 * np.log((t + 1) * float(seen[0] + buckets) / ((s + 1) * float(seen[1] + buckets)))).astype(np.int64)
                sizes = np.frombuffer(column["sizes"][k].as_buffer(), "<u4")
                n = np.frombuffer(counts, "<u4").astype(np.int64)
                value = gains[np.frombuffer(column["places"][k].as_buffer(), "<u4")] * n
                bounds = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                words = np.frombuffer(column["words"][k].as_buffer(), "<i8")
                first = column["shard"][k].as_py() == 0
                own = np.arange(len(sizes)) if first else np.flatnonzero(sizes)  # shard 0 lists documents without features too
                part, n = textkit.segment_sum(value, bounds)[own], textkit.segment_sum(n, bounds)[own]
                ids = column["ids"][k].values.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([ids, pa.array(part), pa.array(n), pa.array(words if first else np.zeros(len(own), np.int64))], ["_id", "part", "features", "words"])

    return cogrouped.mapInArrow(kernel, f"_id {id_type}, part long, features long, words long")


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, longest: int = MAX_RUN) -> DataFrame:
    """(id, n_words, n_features, weight) of every document; weight is the floored mean of its features' gains, 0 without any.

    Rows that share an id, null included, are one document with the features of all of them.
    Null texts have no words.  With an empty target every gain is that of unseen buckets; an
    empty ``docs`` gives no row.  Other columns are ignored.
    """
    if buckets < SHARDS or longest < 1:
        raise ValueError(f"at least {SHARDS} buckets and runs of at least one word")
    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    # the tasks that a shard's postings are dealt to
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS))
    own = _postings(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), buckets, longest, False)
    theirs = _postings(target.select(F.lit(None).cast(id_type).alias("_id"), F.col(target_text_col).alias("_text")), buckets, longest, True)
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    salt = F.pmod(F.xxhash64("places", "counts", "ids"), F.lit(salts)).cast("int")
    dealt = own.union(theirs).withColumn("salt", F.explode(F.when(F.col("kind") < 2, every).otherwise(F.array(salt))))
    dealt = dealt.repartitionById(SHARDS * salts, F.col("shard") * salts + F.col("salt")).drop("salt").sortWithinPartitions("kind")
    found = _contributions(dealt, buckets, id_type).groupBy("_id").agg(F.sum("part").alias("gain"), F.sum("features").alias("n_features"), F.sum("words").alias("n_words"))
    floored = F.expr("case when n_features > 0 then (gain - pmod(gain, n_features)) div n_features else 0 end")
    return found.select(F.col("_id").alias(id_col), "n_words", "n_features", floored.cast("long").alias("weight"))


def drawn_ranks(scored: DataFrame, id_col: str, percent: int) -> DataFrame:
    """``scored`` with rank (1, 2, .. by falling score, ties to the smaller id) for the best ``percent`` of the eligible rows, else null.

    No task sorts more than the rows of one score: what stands before them is a sum of counts.
    """
    counts = scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", F.expr(f"floor(score / {COARSE})"))
    before = Window.orderBy(F.desc("coarse")).rowsBetween(Window.unboundedPreceding, -1)  # one row for COARSE scores
    coarse = counts.groupBy("coarse").agg(F.sum("n").alias("n")).select("coarse", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("coarse").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    fine = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(coarse, "coarse")
    fine = fine.select("score", (F.col("above") + F.col("inner")).alias("above"), F.expr(f"all * {percent} div 100").alias("drawn")).where("above < drawn")
    joined = scored.join(fine, "score", "left")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(id_col))
    best = joined.where("eligible and above is not null").withColumn("rank", place)
    best = best.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long"))
    return best.unionByName(joined.where("not eligible or above is null").withColumn("rank", F.lit(None).cast("long"))).select(*scored.columns, "rank")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, longest: int = MAX_RUN, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: the draw without replacement of ``percent`` of those with ``least_words`` words.

    The score is the weight with Gumbel noise from the sha256 of "seed:id" (null: "seed:"), so the
    best scores are a draw in proportion to the exponential of weight / 1000.  See ``importance_weights`` for nulls,
    repeated ids and empty tables; without eligible documents all ranks are null.
    """
    weights = written(importance_weights(docs, target, id_col, text_col, target_text_col, buckets, longest), "weights")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32)))))
    scored = weights.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("eligible", F.col("n_words") >= least_words)
    return drawn_ranks(scored, id_col, percent).select(id_col, "n_features", "weight", "score", "rank")
