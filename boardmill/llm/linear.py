"""Sparse linear models trained with follow-the-regularised-leader (FTRL-proximal) updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Packed features of a fitted sample, in bytes, that come to the driver at most.
TRAIN_BYTES = 256 << 20


def bounded_sample(packed: DataFrame, order: list, most_rows: int, most_bytes: int = TRAIN_BYTES) -> list:
    """The first rows of ``packed`` (features in its column packed) in this order, as far as rows and their bytes go.

    The sizes come first, so that features beyond the bound never leave the executors; what is
    within it comes a partition at a time.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = packed.select(*[c.alias(k) for c, k in zip(order, keys, strict=True)], "*")
    room, last = most_bytes, None
    for row in keyed.select(*keys, F.length("packed").alias("_size")).orderBy(*keys).limit(most_rows).collect():
        room -= row["_size"]
        if room < 0:
            break
        last = row
    if last is None:
        return []
    edge = F.struct(*[F.lit(last[k]).cast(dict(keyed.dtypes)[k]).alias(k) for k in keys])
    found = sorted(keyed.where(F.struct(*keys) <= edge).toLocalIterator(), key=lambda r: tuple((r[k] is not None, r[k]) for k in keys))
    return found[:most_rows]


class Ftrl:
    """Logistic (one output) or softmax regression with per-coordinate rates and elastic-net penalties."""

    def __init__(self, dims: int, outputs: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims, outputs)), np.zeros((dims, outputs))
        self.bias_z, self.bias_n = np.zeros(outputs), np.zeros(outputs)

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.z, self.n, self.l1, self.l2), self._weights(self.bias_z, self.bias_n, 0.0, 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, target: np.ndarray) -> None:
        """One example: distinct feature places, their values, and the wanted output probabilities."""
        z, n = self.z[index], self.n[index]
        w, bias = self._weights(z, n, self.l1, self.l2), self._weights(self.bias_z, self.bias_n, 0.0, 0.0)
        error = probabilities((value @ w + bias)[None])[0] - target
        for old_z, old_n, old_w, gradient, where in ((z, n, w, value[:, None] * error, index), (self.bias_z, self.bias_n, bias, error, None)):
            new_n = old_n + gradient**2
            new_z = old_z + gradient - (np.sqrt(new_n) - np.sqrt(old_n)) / self.alpha * old_w
            if where is None:
                self.bias_z, self.bias_n = new_z, new_n
            else:
                self.z[where], self.n[where] = new_z, new_n


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Rows of scores as probabilities: the logistic function for one column, softmax for more."""
    if scores.shape[1] == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -40, 40)))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
