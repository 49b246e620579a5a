"""Linear models on sparse rows, in numpy, for bounded training samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Classes whose sizes are broadcast; beyond, the join shuffles.
MAX_BROADCAST = 100_000


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, counts: np.ndarray, columns: np.ndarray, values: np.ndarray | None, width: int) -> None:
        self.n, self.width = len(counts), width
        self.row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.columns = columns
        self.values = values

    def dot(self, w: np.ndarray) -> np.ndarray:
        x = w[self.columns]
        return np.bincount(self.row, weights=x if self.values is None else x * self.values, minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed product."""
        x = r[self.row]
        return np.bincount(self.columns, weights=x if self.values is None else x * self.values, minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def descend(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], rounds: int, rate: float) -> np.ndarray:
    """Adam with a falling rate; deterministic."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b), fitted by Newton steps on smoothed targets."""
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = np.sum(h * margin**2) + 1e-6, np.sum(h * margin), np.sum(h) + 1e-6
        ga, gb = np.sum(d * margin), np.sum(d)
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        if not np.isfinite(a + b):
            return 1.0, 0.0
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def sampled(df: DataFrame, class_col: str, id_col: str, most: int, sizes: dict | None = None) -> DataFrame:
    """About `most` rows of each class, chosen by a hash of the id; all rows of smaller classes.

    The chance of a row is `most` over the rows of its class, so the sample stays so large at any size
    of the table, and a run again takes the same rows.  Classes meet their sizes (`sizes`, if they are
    few and known) in a join; the driver holds none of them.
    """
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(20)), F.lit(1 << 40)) / float(1 << 40)
    if sizes is not None:
        chance = F.lit(0.0)
        for name, n in sizes.items():
            chance = F.when(F.col(class_col) == F.lit(name), F.lit(min(1.0, most / n))).otherwise(chance)
        return df.where(F.col(class_col).isNotNull() & (at < chance))
    counted = df.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("_class")).agg(F.count("*").alias("_n"))
    if counted.count() <= MAX_BROADCAST:  # decides the kind of join only
        counted = F.broadcast(counted)
    return df.join(counted, F.col(class_col) == F.col("_class")).where(at < F.lit(float(most)) / F.col("_n")).drop("_class", "_n")
