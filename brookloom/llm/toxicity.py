"""Operator 4, toxicity by a classifier chain.

Categories are predicted one after the other by logistic models.  Each later model also gets the
probabilities of the earlier categories.  When it is trained those are out-of-fold predictions (FOLDS
folds by a hash of the id), so it learns from probabilities as good as the ones it will meet.  All that a
fold's rows get is learned from the other folds: which features count, the groups, and the weights.

The features are the distinct words of the whole text and their prefixes of 3 to 7 characters, hashed.
A word's features depend on the word only, so a text's score is a sum over its distinct words, whose
scores are remembered.

Where the labels have several columns each is a category, in the given order.  Where only one label column
is there, finer categories come from the data: the labelled toxic rows are put into KINDS groups by the
features that tell them from other rows (k-means on unit vectors, started from rows far apart).  Each
group is a category ("kind_1", the largest, first), and the label itself is the last one and the verdict.

The models are fitted on a sample of at most SAMPLE labelled rows of each class, chosen by a hash of the
id; a class that is larger weighs by its rows.  All other work covers all rows.

Defined cases: null and empty texts have no words and get the models' base rates; texts of any length are
read whole; rows without a label or an id teach nothing; where ids repeat among the labels the more toxic
one holds; a category that is constant in the sample gets that constant; without labels all probabilities
are 1/2 and nothing is toxic; repeated rows are scored one by one; an empty table gives an empty one; an
input column that has the name of an output column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, as_bytes, bounded, ship, state_udf, texts_of, words_of
from .linear import Rows, descend, sampled, sigmoid

#: Labelled rows of each class that the models are fitted on.
SAMPLE = 2500
#: Groups of toxic rows.
KINDS = 2
FOLDS = 3
THRESHOLD = 0.5
#: Times that a feature must be more frequent in toxic rows.
LIFT = 4.0
BITS = 18
WIDTH = 1 << BITS
PREFIXES = (3, 4, 5, 6, 7)
#: Distinct words whose scores a Python worker remembers; beyond, it starts anew.
CACHE = 75_000
def features_of(word: bytes) -> list[int]:
    """The word and its prefixes (of characters), hashed."""
    found = [zlib.crc32(word, 1) & (WIDTH - 1)]
    text = word.decode("utf-8", "replace")
    for n in PREFIXES:
        if len(text) >= n:
            found.append(zlib.crc32(text[:n].encode(), n + 1) & (WIDTH - 1))
    return found


def kinds_of(rows: Rows, of_word: Rows, kinds: int, rounds: int = 10, width: int = 64) -> np.ndarray:
    """The group, from 0 (the largest), of each row of a table of features (rows of words, words of features): spherical k-means on random signs of the features."""
    signs = np.where(np.random.default_rng(11).random((of_word.width, width)) < 0.5, -1.0, 1.0)
    x = np.column_stack([rows.dot(of_word.dot(signs[:, k])) for k in range(width)]).astype(float)  # whole numbers where there are no features
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x.sum(axis=0) / max(np.linalg.norm(x.sum(axis=0)), 1e-12)]
    while len(centres) <= kinds:  # the first stands for all rows and only says which one is farthest
        centres.append(x[np.argmin(np.max(x @ np.array(centres[1:] or centres).T, axis=1))])
    centres = np.array(centres[1:])
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[at == k].sum(axis=0) for k in range(kinds)])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    at = (x @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-np.bincount(at, minlength=kinds), kind="stable"))
    return place[at]


@dataclass
class _View:
    """Training rows by the features that some of them have shown to matter."""

    features: np.ndarray
    rows: Rows
    of_word: Rows
    labels: np.ndarray

    def predict(self, w: np.ndarray, before: np.ndarray) -> np.ndarray:
        width = len(self.features)
        return sigmoid(self.rows.dot(self.of_word.dot(w[:width])) + before @ w[width:-1] + w[-1])


class ToxicityChain:
    def __init__(self, categories: tuple[str, ...] = ()) -> None:
        self.categories = categories
        self.features = np.zeros(0, np.int64)  # the hashed features with weights, sorted
        self.weights = np.zeros((len(categories), 0))
        self.bias = np.zeros(len(categories))
        self.links = np.zeros((len(categories), len(categories)))  # of later categories to earlier ones
        self._known: dict[bytes, int] = {}
        self._scores: list[np.ndarray] = []

    @classmethod
    def fit(cls, words: Iterable[list[bytes]], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...], weights: np.ndarray | None = None, kinds: int = 0, rounds: int = 80, l2: float = 2e-4) -> ToxicityChain:
        """words: distinct words of each row; labels: a column for each category; kinds: groups that become categories before them."""
        model = cls((*(f"kind_{k + 1}" for k in range(kinds)), *categories))
        categories = model.categories
        model.weights, model.bias, model.links = np.zeros((len(categories), 0)), np.zeros(len(categories)), np.zeros((len(categories), len(categories)))
        if not len(labels):
            return model
        weights = np.ones(len(labels)) if weights is None else weights
        number: dict[bytes, int] = {}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)) for own in words]
        # only features of at least three positive rows, and far rarer in the others, speak for a category
        distinct = list(number)
        del number
        parts = []
        for at in range(0, len(distinct), 20_000):  # a part at a time: lists of features are large
            own = [features_of(w) for w in distinct[at : at + 20_000]]
            parts.append((np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(chain.from_iterable(own), np.int32)))
        owner = np.repeat(np.arange(len(distinct), dtype=np.int32), np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)]))
        hashes = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int32)])
        rows = Rows(np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids), None, len(distinct))
        del parts, ids
        toxic = labels.max(axis=1) > 0

        def seen_by(rows_used: np.ndarray) -> _View:
            """Features, words and labels as some of the rows show them, for all rows."""
            yes, no = toxic & rows_used, ~toxic & rows_used
            seen, others = (np.bincount(hashes, weights=rows.back(y.astype(float))[owner], minlength=WIDTH) for y in (yes, no))
            odds = (seen / max(1, yes.sum())) / ((others + 0.5) / max(1, no.sum()))
            features = np.flatnonzero((seen >= 3) & (odds >= LIFT))
            place = np.full(WIDTH, -1)
            place[features] = np.arange(len(features))
            keep = place[hashes] >= 0
            per_word = np.bincount(owner[keep], minlength=len(distinct))
            of_word = Rows(per_word, place[hashes[keep]], None, len(features))
            # words without such a feature add nothing
            useful = per_word[rows.columns] > 0
            own = Rows(np.bincount(rows.row[useful], minlength=rows.n), rows.columns[useful], None, rows.width)
            y = labels
            if kinds:
                group = np.where(yes, kinds_of(Rows(np.where(yes, np.bincount(own.row, minlength=own.n), 0), own.columns[yes[own.row]], None, own.width), of_word, kinds), -1)
                y = np.column_stack([*(group == k for k in range(kinds)), labels]).astype(int)
            return _View(features, own, of_word, y)

        def train(view: _View, c: int, before: np.ndarray, use: np.ndarray) -> np.ndarray:
            y, width = view.labels[:, c].astype(float), len(view.features)
            share = np.clip(np.average(y, weights=use), 1e-4, 1 - 1e-4)
            start = np.zeros(width + before.shape[1] + 1)
            start[-1] = np.log(share / (1 - share))
            if len(set(y[use > 0])) < 2:
                start[-1] = 12.0 if share > 0.5 else -12.0
                return start

            def gradient(w: np.ndarray) -> np.ndarray:
                r = (view.predict(w, before) - y) * use / use.sum()
                return np.concatenate((view.of_word.back(view.rows.back(r)) + l2 * w[:width], before.T @ r + l2 * w[width:-1], [r.sum()]))

            return descend(start, gradient, rounds, 0.1)

        # what a fold's rows get was learned from the others alone: features, groups and weights
        out_of_fold = model.out_of_fold = np.zeros((len(labels), len(categories) - 1))
        for k in np.unique(folds) if len(categories) > 1 else []:
            others, own = folds != k, folds == k
            if not others.any():
                out_of_fold[own] = 0.5
                continue
            view, before = seen_by(others), np.zeros((len(labels), 0))
            for c in range(len(categories) - 1):
                p = view.predict(train(view, c, before, weights * others), before)
                out_of_fold[own, c] = p[own]
                before = np.column_stack((before, p))
        view = seen_by(np.ones(len(labels), bool))
        model.features, width = view.features, len(view.features)
        model.weights = np.zeros((len(categories), width))
        for c in range(len(categories)):
            w = train(view, c, out_of_fold[:, :c], weights)
            model.weights[c], model.links[c, :c], model.bias[c] = w[:width], w[width:-1], w[-1]
        return model

    def _score_words(self, words: list[bytes]) -> np.ndarray:
        own = [features_of(w) for w in words]
        at = np.array([f for o in own for f in o], np.int64)
        owner = np.repeat(np.arange(len(own)), [len(o) for o in own])
        if not len(self.features):
            return np.zeros((len(words), len(self.categories)))
        place = np.searchsorted(self.features, at)
        place[place == len(self.features)] = 0
        hit = self.features[place] == at
        return np.column_stack([np.bincount(owner[hit], weights=w[place[hit]], minlength=len(words)) for w in self.weights])

    def predict(self, texts: list[bytes | None]) -> np.ndarray:
        """A probability for each text and category."""
        sets = [set(words_of(t)) for t in texts]
        new = list(set().union(*sets).difference(self._known))
        if not self._scores or len(self._known) + len(new) > CACHE:
            self._known, self._scores = {}, [np.zeros((0, len(self.categories)))]
            new = list(set().union(*sets))
        if new:
            base = len(self._known)
            self._known.update(zip(new, range(base, base + len(new)), strict=True))
            self._scores.append(self._score_words(new))
            if len(self._scores) > 16:
                self._scores = [np.concatenate(self._scores)]
        scores = self._scores[0] if len(self._scores) == 1 else np.concatenate(self._scores)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        at = np.fromiter((i for s in sets for i in sorted(map(self._known.__getitem__, s))), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(sets)), sizes)
        out = np.zeros((len(texts), len(self.categories)))
        for c in range(len(self.categories)):
            z = np.bincount(row, weights=scores[at, c], minlength=len(texts)) + out[:, :c] @ self.links[c, :c] + self.bias[c]
            out[:, c] = sigmoid(z)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "out_of_fold"} | {"_known": {}, "_scores": []}


_SENT = T.StructType([T.StructField("i", T.StringType()), T.StructField("y", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType())])


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_cols: tuple[str, ...] = ("toxic",), use: Column | None = None, sample: int = SAMPLE, kinds: int = KINDS) -> ToxicityChain:
    """Learn from the labelled rows where `use` (a condition on the labels) holds; the last label column is the verdict, and with only one `kinds` groups stand before it."""
    ship(docs.sparkSession)
    last = label_cols[-1]
    chosen = labels.where(F.col(last).isNotNull() & F.col(id_col).isNotNull() & (F.lit(True) if use is None else use))
    # one label for an id: the more toxic one, if they differ
    chosen = chosen.groupBy(F.col(id_col).alias("i")).agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"y{k}") for k, c in enumerate(label_cols)))
    verdict = f"y{len(label_cols) - 1}"
    sizes = {r[0]: r[1] for r in chosen.groupBy(verdict).count().collect()}  # two classes
    chosen = sampled(chosen, verdict, "i", sample, sizes).select("i", F.array(*(f"y{k}" for k in range(len(label_cols)))).alias("y"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")  # `sample` rows of a class

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                out = [b" ".join(sorted(set(words_of(t)))) for t in texts_of(batch, "t")]
                yield pa.RecordBatch.from_arrays([batch.column("i").cast(pa.string()), batch.column("y").cast(pa.list_(pa.int32())), pa.array(out, pa.binary())], names=_SENT.names)

    got = sorted((r["i"], tuple(r["y"]), bytes(r["words"])) for r in rows.select("i", "y", "t").mapInArrow(gather, _SENT).collect())
    y = np.array([g[1] for g in got], int).reshape(len(got), len(label_cols))
    folds = np.array([zlib.crc32(g[0].encode(), 7) % FOLDS for g in got])
    verdicts = y[:, -1]
    weights = np.array([sizes[v] / max(1, (verdicts == v).sum()) for v in verdicts.tolist()]) if len(got) else np.zeros(0)
    return ToxicityChain.fit((g[2].split() for g in got), y, folds, label_cols, weights / weights.mean() if len(got) else weights, kinds if len(label_cols) == 1 else 0)


def score(df: DataFrame, model: ToxicityChain, *, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """df with a probability p_<category> for each category, and is_toxic by the last one."""
    fields = [T.StructField(f"p_{c}", T.DoubleType()) for c in model.categories] + [T.StructField("is_toxic", T.BooleanType())]

    def compute(batches):
        for batch in batches:
            p = model.predict(texts_of(batch, text_col))
            yield [*p.T, p[:, -1] >= threshold]

    return add_columns(df, fields, compute, [text_col], keep)


def without_toxic(docs: DataFrame, model: ToxicityChain, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the chain doesn't find toxic; only verdicts come back from Python."""
    ship(docs.sparkSession)

    def compute(slices):
        for (texts,) in slices:
            yield pa.array(model.predict(as_bytes(texts))[:, -1] < threshold)

    return docs.where(state_udf(compute, T.BooleanType(), F.col(f"`{text_col}`").cast("string")))

