"""Operator 3, language identification by hierarchical discrimination.

First the language family is predicted by linear one-versus-rest machines, then one-versus-one linear
support vector machines separate the languages of that family by votes, and by margins where votes tie.
The features are hashed byte n-grams (1 to 4) of the lower-cased text without punctuation, as shares of
its n-grams, so a score is a mean of weights and whole texts of any length are scored in one pass.

The models are fitted on a sample of SAMPLE rows of each language, chosen by a hash of the id, of the LANGUAGES
that most rows name (ties go by code); all other work covers all rows.  A language that FAMILIES doesn't
know is a family of its own.

Defined cases: an empty table gives an empty one; repeated rows are identified one by one; an input column
that has the name of an output column is replaced; a null text, or one without a letter, is `und` with score 0; rows of null language
teach nothing; without any learned language every text is `und`; with one, all texts with a letter
are of it.  The score is the product of the calibrated probabilities of the family and of the
closest pair decision in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, add_columns, bounded, ship, texts_of
from .linear import Rows, descend, platt, sampled, sigmoid
from .ngrams import WIDTH, counts, joined, mean_weights

SAMPLE = 600
#: Languages that are learned at most: what is fitted, and sent to the executors, stays bounded whatever the codes are.
LANGUAGES = 100
SIZES = (1, 2, 3, 4)
#: Shares are small numbers; weights and shares are scaled alike.
SCALE = 100.0
UNKNOWN = "und"
#: Families of languages by code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "semitic": ["ar", "he", "am", "mt"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "uralic": ["fi", "et", "hu"],
}
_LETTER = re.compile(rb"[A-Za-z]")


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), f"only {language}")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode()))


class LanguageModel:
    """Weights of all machines and how they are put together."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = sorted(languages)
        self.families = sorted({family_of(x) for x in languages})
        self.members = {f: [x for x in self.languages if family_of(x) == f] for f in self.families}
        #: (what is told from what, bias, a, b of its calibration)
        self.machines: list[tuple[tuple, float, float, float]] = []
        self.weights = np.zeros((0, WIDTH), np.float32)

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
        """rows: language, buckets, shares."""
        model = cls(sorted({r[0] for r in rows}))
        weights = []
        tasks: list[tuple[tuple, list, list]] = []
        # with two families one machine tells them apart
        for f in model.families[: 1 if len(model.families) == 2 else None] if len(model.families) > 1 else []:
            tasks.append((("family", f), [r for r in rows if family_of(r[0]) == f], [r for r in rows if family_of(r[0]) != f]))
        for f in model.families:
            for a, b in combinations(model.members[f], 2):
                tasks.append((("pair", a, b), [r for r in rows if r[0] == a], [r for r in rows if r[0] == b]))
        for what, yes, no in tasks:
            w, bias, a, b = _machine(yes, no)
            weights.append(w)
            model.machines.append((what, bias, a, b))
        model.weights = np.array(weights, np.float32).reshape(-1, WIDTH)
        return model

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        usable = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not usable:
            return names, scores
        data, starts = joined([texts[i] for i in usable], WORD_TABLE)
        z = mean_weights(data, starts, SIZES, self.weights) * SCALE
        p = {what: sigmoid(a * (z[:, k] + bias) + b) for k, (what, bias, a, b) in enumerate(self.machines)}
        n = len(usable)
        if len(self.families) == 1:
            family = np.ones((n, 1))
        elif len(self.families) == 2:
            first = p["family", self.families[0]]
            family = np.stack([first, 1 - first], axis=1)
        else:
            family = np.stack([p["family", f] for f in self.families], axis=1)
            family = family / np.maximum(family.sum(axis=1, keepdims=True), 1e-12)
        best = family.argmax(axis=1)
        for f, name in enumerate(self.families):
            own = np.flatnonzero(best == f)
            members = self.members[name]
            votes, margin, least = (np.zeros((len(own), len(members))) for _ in range(3))
            least += 1.0
            for i, j in combinations(range(len(members)), 2):
                q = p["pair", members[i], members[j]][own]
                votes[:, i] += q >= 0.5
                votes[:, j] += q < 0.5
                margin[:, i] += q
                margin[:, j] += 1 - q
                least[:, i] = np.minimum(least[:, i], q)
                least[:, j] = np.minimum(least[:, j], 1 - q)
            won = (votes + margin / (len(members) + 1)).argmax(axis=1)
            for k, i in enumerate(own.tolist()):
                names[usable[i]] = members[won[k]]
                scores[usable[i]] = float(family[i, f] * least[k, won[k]])
        return names, scores


def _machine(yes: list, no: list, l2: float = 1e-4, rounds: int = 60) -> tuple[np.ndarray, float, float, float]:
    """A linear support vector machine (squared hinge, classes weighing alike) and its calibration."""
    rows = yes + no
    x = Rows(np.array([len(r[1]) for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.int64), np.concatenate([r[2] for r in rows]).astype(np.float64) * SCALE, WIDTH)
    y = np.repeat([1.0, -1.0], [len(yes), len(no)])
    weight = np.repeat([0.5 / len(yes), 0.5 / len(no)], [len(yes), len(no)])

    def gradient(w: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - y * (x.dot(w[:-1]) + w[-1])) * weight * y
        return np.concatenate((l2 * w[:-1] - 2 * x.back(slack), [-2 * slack.sum()]))

    w = descend(np.zeros(WIDTH + 1), gradient, rounds, 0.05)
    a, b = platt(x.dot(w[:-1]) + w[-1], y)
    if a > 4:  # rows it was fitted on are all far from the border
        a, b = 4.0, b * 4 / a
    return w[:-1].astype(np.float32), float(w[-1]), a, b


_FEATURES = T.StructType([T.StructField("name", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())])


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", use: Column | None = None, sample: int = SAMPLE, languages: int = LANGUAGES) -> LanguageModel:
    """Learn from the rows where `use` holds and the language isn't null: at most `sample` of each, of at most `languages`."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & (F.lit(True) if use is None else use)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                out = [(name, *counts(t, WORD_TABLE, SIZES)) for t, name in zip(texts_of(batch, "t"), batch.column("l").to_pylist(), strict=True) if has_letter(t)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1].tobytes() for o in out], pa.binary()), pa.array([o[2].tobytes() for o in out], pa.binary())], names=_FEATURES.names)

    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages).collect()}
    got = sampled(rows, "l", "i", sample, sizes).mapInArrow(features, _FEATURES).collect()
    got = sorted(((r["name"], bytes(r["at"]), bytes(r["share"])) for r in got))  # the order of rows has no say
    return LanguageModel.fit([(n, np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for n, a, s in got])


def identify(df: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with lang_pred and score for each row."""

    def compute(batches):
        for batch in batches:
            yield list(model.predict(texts_of(batch, text_col)))

    return add_columns(df, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], compute, [text_col], keep)
