"""Centroid clustering of integer vectors: Lloyd rounds with partial-distance search.

Vectors are read once, turned into whole numbers and written, packed, to the shared folder.  A round
reads that table: each task assigns its vectors to the centroids, of which there is a fixed number,
and emits one sum for each cluster and dimension; Spark adds them up, and a table of clusters x
dimensions numbers comes to the driver, as large for any input.  A squared distance is added up
over groups of dimensions, those of high variance first, and a centroid is abandoned for a vector
as soon as its partial sum is strictly above the best distance so far; vectors that are left
after all dimensions have the exact distance.  All sums are exact whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Dimensions that are added up before centroids are abandoned again.
GROUP = 8
#: Components are below this in size, so that squared distances of up to 1,024 dimensions fit 64 bits.
MOST = 1 << 26
#: Vectors that are compared at once.
SLICE = 8_192


def whole_vectors(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are complete and finite, and floor(scale * x) of their components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dimensions)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    finite = np.isfinite(values).all(axis=1)  # a null component is read as NaN
    x = np.floor(values[finite] * scale)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"components times {scale} must be below {MOST} in size")
    return rows[finite], x.astype(np.int32)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of numbers."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _numbers(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of each row; of equally near ones the smallest number.

    ``order`` is the order in which dimensions are added up; it doesn't change the result.
    """
    x, centroids = x[:, order].astype(np.int64), centroids[:, order]
    difference = x - centroids[0]
    best, label = np.einsum("ij,ij->i", difference, difference), np.zeros(len(x), np.int32)
    for k in range(1, len(centroids)):
        rows, partial = np.arange(len(x)), np.zeros(len(x), np.int64)
        for at in range(0, x.shape[1], GROUP):
            difference = x[rows, at : at + GROUP] - centroids[k, at : at + GROUP]
            partial += np.einsum("ij,ij->i", difference, difference)
            left = partial <= best[rows]
            rows, partial = rows[left], partial[left]
            if not len(rows):
                break
        closer = partial < best[rows]
        best[rows[closer]], label[rows[closer]] = partial[closer], k
    return label, best


def _by_variance(packed: DataFrame, dimensions: int) -> np.ndarray:
    """The dimensions, those of high variance first; computed in doubles, as it only steers the search."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, dimensions))
        for batch in batches:
            x = _numbers(batch.column(0), dimensions).astype(np.float64)
            sums += np.stack([np.full(dimensions, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions), pa.int32()), *map(pa.array, sums)], ["d", "n", "s", "q"])

    found = packed.select("_v").mapInArrow(kernel, "d int, n double, s double, q double")
    rows = found.groupBy("d").agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("variance"))
    return np.array([r.d for r in rows.orderBy(F.desc("variance"), "d").collect()])  # ``dimensions`` rows


def _totals(packed: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums by (cluster, part): part d is dimension d, then come the count and the sum of distances."""
    n, dimensions = centroids.shape

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, dimensions + 2), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = _numbers(batch.column(0).slice(at, SLICE), dimensions)
                label, distance = nearest(x, centroids, order)
                for k in range(n):
                    own = label == k
                    sums[k] += np.r_[x[own].sum(axis=0, dtype=np.int64), own.sum(), distance[own].sum()]
        cluster, part = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel(), pa.int32()), pa.array(part.ravel(), pa.int32()), pa.array(sums.ravel())], ["cluster", "part", "total"])

    found = packed.select("_v").mapInArrow(kernel, "cluster int, part int, total long")
    rows = found.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # clusters x (dimensions + 2)
    return {(r.cluster, r.part): int(r.total) for r in rows}


def _key(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite; they are
    clustered as floor(scale * component).  The vectors with the smallest sha256 of "seed:id" are
    the first centroids; a null id has the hash of "seed:", and rows that share an id are told
    apart by their vectors.  If fewer vectors than ``clusters`` are kept, each is a centroid.
    Repeated rows are vectors of their own.  An empty table, or one without a vector to keep, gives
    no row.  Other columns are ignored.  Components of 2**26 / scale or more in size are an error,
    as their distances wouldn't fit a long.
    """
    if not 0 < dimensions <= 1024 or clusters < 1:
        raise ValueError("1 to 1,024 dimensions and at least one cluster")
    kind = dict(vectors.dtypes)[id_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column(1), dimensions, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _binary(x.astype("<i4"))], ["_id", "_v"])

    read = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    packed = written(read.mapInArrow(pack, f"_id {kind}, _v binary"), "vectors")
    first = packed.select(_key("_id", seed).alias("h"), "_v").orderBy("h", "_v").limit(clusters).collect()
    centroids = np.array([np.frombuffer(r["_v"], "<i4") for r in first], np.int64).reshape(-1, dimensions)
    order = np.arange(dimensions)
    if len(centroids):
        order = _by_variance(packed, dimensions)
        for _ in range(rounds):
            total = _totals(packed, centroids, order)
            moved = np.array([[total[k, d] // total[k, dimensions] for d in range(dimensions)] if total[k, dimensions] else c for k, c in enumerate(centroids.tolist())], np.int64)
            if (moved == centroids).all():
                break  # further rounds change nothing
            centroids = moved
    total = _totals(packed, centroids, order) if len(centroids) else {}
    inertia = [total[k, dimensions + 1] for k in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                label, distance = nearest(_numbers(rows.column(1), dimensions), centroids, order)
                own = [np.array(inertia, np.int64)[label], np.full(len(label), sum(inertia)), np.array(names)[label]]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(label), pa.array(distance), *map(pa.array, own)], list(schema))

    schema = {"_id": kind, "cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    return packed.mapInArrow(assign, ", ".join(f"{c} {t}" for c, t in schema.items())).withColumnRenamed("_id", id_col)
