"""Operator 9, a quality classifier by positive-unlabelled learning.

A linear model is trained on trusted positives (rows labelled 1) and unlabelled web text.  With the class
prior p it minimises the non-negative unbiased risk
    p * R_p(+) + max(0, R_u(-) - p * R_p(-))
under the logistic loss; where the second term falls below zero the step goes against it, as the
published method has it.  The prior is estimated from the two samples alone: the smallest ratio, over
thresholds of a first model's score, of the share of unlabelled texts above it to that of positives.

Features: the shape of the text as hashed n-grams (1 to 4) of byte classes (small, capital, digit, letter
beyond ASCII, other characters as they are), as shares; and a few counts: length, distinct words, longest
run of one word, word length.  Both are taken from the whole text.

The model is fitted on about SAMPLE positives and SAMPLE unlabelled texts, chosen by a hash of the id; all
other work covers all rows.  Labels are read from the rows that `use` leaves; no negative label is used.

Defined cases: null and empty texts have zero features and get a score from those; without any positive
every score is the prior 0.5; texts of any length are read whole; repeated rows are scored one by one, and an
id that is labelled several times is one positive; an empty table gives an empty one; an input column that
has the name of an output column is replaced.  The estimated prior is held between 0.05 and 0.98.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bounded, ship, texts_of
from .linear import Rows, descend, sampled, sigmoid
from .ngrams import WIDTH, counts, joined, mean_weights

SAMPLE = 2500
THRESHOLD = 0.7
SIZES = (1, 2, 3, 4)
SCALE = 30.0
#: a small letter, A capital, 0 digit, ~ a byte beyond ASCII; others are themselves.
SHAPE = bytes(0x61 if 0x61 <= b <= 0x7A else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else 0x7E if b >= 0x80 else b for b in range(256))
DENSE = 6


def dense_of(text: bytes | None) -> list[float]:
    """A few counts of a text, each about 0 to 1."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * DENSE
    run = max(sum(1 for _ in same) for _, same in groupby(words))
    lines = text.split(b"\n")
    return [
        np.log1p(n) / 10,
        len(set(words)) / n,
        min(1.0, run / 10),
        min(1.0, len(text) / n / 20),
        len(set(lines)) / len(lines),
        1.0,
    ]


def repeated(text: bytes | None) -> float:
    """The share of words that stand right after themselves."""
    words = (text or b"").split()
    return sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)


class QualityModel:
    def __init__(self) -> None:
        self.weights = np.zeros((1, WIDTH), np.float32)
        self.dense = np.zeros(DENSE + 1)
        self.bias = 0.0
        self.prior = 0.5

    @classmethod
    def fit(cls, positive: list[tuple], unlabelled: list[tuple], prior: float | None = None, rounds: int = 200, l2: float = 1e-4) -> QualityModel:
        """Rows are (buckets, shares, dense)."""
        model = cls()
        if not positive or not unlabelled:
            return model
        rows = positive + unlabelled
        x = Rows(np.array([len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]).astype(float) * SCALE, WIDTH)
        d = np.array([r[2] for r in rows])
        p_rows = np.arange(len(rows)) < len(positive)
        p_each, u_each = p_rows / len(positive), ~p_rows / len(unlabelled)

        def margin(w: np.ndarray) -> np.ndarray:
            return x.dot(w[:WIDTH]) + d @ w[WIDTH:-1] + w[-1]

        def back(r: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.concatenate((x.back(r) + l2 * w[:WIDTH], d.T @ r + l2 * w[WIDTH:-1], [r.sum()]))

        zero = np.zeros(WIDTH + DENSE + 2)
        if prior is None:
            first = descend(zero, lambda w: back((sigmoid(margin(w)) - p_rows) * (p_each + u_each) / 2, w), 60, 0.1)
            prior = estimate_prior(margin(first)[p_rows], margin(first)[~p_rows])
        model.prior = prior

        def gradient(w: np.ndarray) -> np.ndarray:
            z = margin(w)
            s = sigmoid(z)
            loss = np.logaddexp(0, z)  # of calling a text negative
            rest = loss @ u_each - prior * (loss @ p_each)
            r_rest = s * u_each - prior * s * p_each
            if rest < 0:
                return back(-r_rest, w)
            return back(prior * (s - 1) * p_each + r_rest, w)

        w = descend(zero, gradient, rounds, 0.1)
        model.weights = w[:WIDTH].astype(np.float32)[None, :]
        model.dense, model.bias = w[WIDTH:-1], float(w[-1])
        return model

    def predict(self, texts: list[bytes | None]) -> np.ndarray:
        data, starts = joined([t or b"" for t in texts], SHAPE)
        z = mean_weights(data, starts, SIZES, self.weights)[:, 0] * SCALE
        empty = np.array([not t for t in texts], bool)
        z[empty] = 0.0
        d = np.array([[*dense_of(t), repeated(t)] for t in texts]).reshape(len(texts), DENSE + 1)
        return sigmoid(z + d @ self.dense + self.bias)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest share of unlabelled scores above a threshold, for one of positives above it; thresholds keep four fifths of the positives at least, so that few texts decide none of them."""
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    at = positive[: max(1, len(positive) // 5)]
    above_p = 1 - np.searchsorted(positive, at) / len(positive)
    above_u = 1 - np.searchsorted(unlabelled, at) / len(unlabelled)
    return float(np.clip((above_u / above_p).min(), 0.05, 0.98))


def features_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    at, share = counts(text, SHAPE, SIZES) if text else (np.zeros(0, np.int32), np.zeros(0, np.float32))
    return at, share, [*dense_of(text), repeated(text)]


_SENT = T.StructType([T.StructField("i", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType()), T.StructField("dense", T.ArrayType(T.DoubleType()))])


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", use: Column | None = None, sample: int = SAMPLE, prior: float | None = None) -> QualityModel:
    """Learn from the positive labels where `use` (a condition on the labels) holds, and from texts of any row."""
    ship(docs.sparkSession)
    positive = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull() & (F.lit(True) if use is None else use)).select(F.col(id_col).alias("i")).distinct()
    positive = sampled(positive.withColumn("y", F.lit(1)), "y", "i", sample)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    trusted = rows.join(F.broadcast(positive), "i").select("i", "t", "y")  # `sample` ids
    n = docs.select(F.lit(1)).count()
    at = F.pmod(F.xxhash64("i", F.lit(21)), F.lit(1 << 40)) / float(1 << 40)
    web = rows.where(at < min(1.0, sample / max(1, n))).select("i", "t", F.lit(0).alias("y"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                out = [features_of(t) for t in texts_of(batch, "t")]
                yield pa.RecordBatch.from_arrays([batch.column("i").cast(pa.string()), batch.column("y").cast(pa.int32()), pa.array([o[0].tobytes() for o in out], pa.binary()), pa.array([o[1].tobytes() for o in out], pa.binary()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=_SENT.names)

    got = sorted((r["y"], r["i"], bytes(r["at"]), bytes(r["share"]), list(r["dense"])) for r in trusted.unionByName(web).mapInArrow(gather, _SENT).collect())
    both = [[(np.frombuffer(g[2], np.int32), np.frombuffer(g[3], np.float32), g[4]) for g in got if g[0] == y] for y in (1, 0)]
    return QualityModel.fit(*both, prior=prior)


def score(df: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold)."""

    def compute(batches):
        for batch in batches:
            s = model.predict(texts_of(batch, text_col))
            yield [s, (s >= threshold).astype(np.int32)]

    return add_columns(df, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute, [text_col], keep)
