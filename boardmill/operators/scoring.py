"""A place for models: scorers that get whole Arrow batches, and views of their input.

A scorer is loaded once in each Python worker from a file that the session has distributed, and
called with a matrix of a batch's rows.  Views are permutations of the input (turned or mirrored
boards), each with the permutation that turns its answer back; answers are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray], np.ndarray]
#: Rows that a scorer gets at once.
ROWS_EACH = 4_096
_loaded: dict[tuple[str, str], Scorer] = {}


def scored(df: DataFrame, keys: list[str], features: str, model_file: str, load: Callable[[str], Scorer], outputs: int, views: list[tuple[list[int], list[int]]] | None = None) -> DataFrame:
    """(keys, scores) of every row: the model's answers to its features, an array of numbers, averaged over ``views``.

    ``model_file`` is the name of a file that ``sc.addFile`` distributed; ``load`` makes a scorer of
    its path: rows x features to rows x ``outputs``.  A view is (places, back): the model gets
    features[places], and its answer[back] counts.  Rows with null features, a null or non-finite
    number among them, or another length than the first view, or than most rows' without views,
    have null scores.
    """
    width = len(views[0][0]) if views else (df.groupBy(F.size(features).alias("n")).count().where("n >= 0").orderBy(F.desc("count"), "n").limit(1).collect() or [[0]])[0][0]
    kinds = dict(df.dtypes)
    turns = views or [(list(range(width)), list(range(outputs)))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (model_file, SparkFiles.get(model_file))
        if place not in _loaded:
            _loaded[place] = load(place[1])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_EACH):
                rows = batch.slice(at, ROWS_EACH)
                column = rows.column(len(keys))
                whole = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == width)
                x = column.take(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
                good = np.isfinite(x).all(axis=1)
                answer = sum(_loaded[place](x[good][:, p])[:, back] for p, back in turns) / len(turns) if good.any() else np.zeros((0, outputs))
                place_of = np.full(rows.num_rows, -1)
                place_of[whole[good]] = np.arange(int(good.sum()))
                values = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(answer, np.float64).ravel()), outputs).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(keys))), values.take(pa.array(place_of, mask=place_of < 0))], [*keys, "scores"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "scores array<double>"])
    return df.select(*keys, features).mapInArrow(kernel, schema)


def linear(path: str) -> Scorer:
    """A scorer of a file with a matrix, features x outputs, as numpy saves it."""
    weights = np.load(path)
    return lambda x: x @ weights


def best_view(scores: list[str]) -> tuple:
    """(scores, view) expressions of the view whose largest answer is largest, the first of equals."""
    ranked = F.array_max(F.array(*[F.struct(F.array_max(s).alias("top"), F.lit(-k).alias("k")) for k, s in enumerate(scores)]))
    return F.get(F.array(*scores), -ranked["k"]), -ranked["k"]
