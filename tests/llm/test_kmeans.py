import hashlib
import math
import random

import numpy as np
import pytest

from boardmill.llm import kmeans
from boardmill.llm.kmeans import centroid_clusters, nearest


def brute(rows, clusters=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:clusters]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[place(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *reversed(place(v))) for i, v in kept]
    own = [sum(d for _, k, d in found if k == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, own[k], sum(own), names[k]) for i, k, d in found), key=repr)


def vectors(seed, n, dims=64, spread=0.4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(7 * i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_brute_force(spark, kind):
    rows = vectors(1, 300)
    if kind == "float":
        rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert got(centroid_clusters(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5))) == brute(rows)


def test_ties_and_empty_clusters(spark):
    # whole numbers on a small grid: many vectors are equally near to two centroids, and equal seeds leave a cluster empty
    rng = random.Random(4)
    rows = [(i, [rng.randrange(3) / 1024 for _ in range(4)]) for i in range(200)] + [(i, [0.0] * 4) for i in range(200, 260)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(centroid_clusters(frame, dimensions=4, clusters=12)) == brute(rows, 12, dims=4)


def test_rows_that_are_not_kept_nulls_repeats_and_clashing_columns(spark):
    good = vectors(2, 30)
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [math.nan] + [1.0] * 63), (8, [math.inf] + [1.0] * 63)]
    rows = good + bad + [good[0]] * 40 + [(None, good[3][1]), (None, good[4][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as distance", "2 as _id", "3 as _v")
    assert got(centroid_clusters(frame)) == brute(rows)
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<double>")
    assert got(centroid_clusters(few)) == brute(good[:3])
    for none in (few.limit(0), spark.createDataFrame(bad, "vec_id long, embedding array<double>")):
        empty = centroid_clusters(none)
        assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_out_of_range_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="must be below"):
        centroid_clusters(frame).collect()


def test_partial_distances_change_no_result():
    rng = np.random.default_rng(3)
    x, centroids = rng.integers(-50, 50, (2_000, 24)), rng.integers(-50, 50, (9, 24))
    centroids[5] = centroids[2]  # always a tie
    whole = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    for order in (np.arange(24), rng.permutation(24)):
        label, distance = nearest(x, centroids, order)
        assert (label == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all() and not (label == 5).any()


def test_abandoned_centroids_cost_less(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (500, 64))
    x[:, 3] = rng.integers(-4000, 4000, 500)
    seen, real = [], np.einsum
    monkeypatch.setattr(kmeans.np, "einsum", lambda *a: seen.append(a[1].size) or real(*a))
    variance = np.argsort(-x.var(axis=0), kind="stable")
    nearest(x, x[:8].copy(), variance)
    assert sum(seen) < 0.5 * 500 * 8 * 64
