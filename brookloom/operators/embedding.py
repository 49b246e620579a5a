"""Embedders as plug-ins: a model loaded once a worker, texts in batches of about one length, stores embedded anew.

An embedder is a function without arguments that loads a model: a function from a list of texts to a matrix
with a row for each.  It goes to the executors by reference or by value; what it loads stays in the worker and
serves all later tasks of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shipping import ship

Model = Callable[[list[str]], np.ndarray]
#: Texts of a call, and calls whose texts are put in order of length together; bytes of rows from which on no more are gathered for that.
BATCH, AHEAD, HELD_BYTES = 256, 16, 8 << 20
_LOADED: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The model of a name, loaded at its first use in this process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the token vectors that a mask keeps, by text, at length 1; zeros for a text without any."""
    kept = mask.astype(np.float64)[:, :, None]
    mean = (tokens * kept).sum(1) / np.maximum(kept.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def by_tokens(load: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]) -> Callable[[], Model]:
    """An embedder from one whose model gives token vectors and a mask: their pooled means."""

    def whole() -> Model:
        model = load()
        return lambda texts: pooled(*model(texts))

    return whole


def _hashed(texts: list[str], size: int) -> np.ndarray:
    out = np.zeros((len(texts), size))
    for k, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            h = xxhash.xxh64_intdigest(word.encode(), 42)
            h -= (h >> 63) << 64
            out[k, h % size] += 1.0 if (h >> 32) % 2 == 0 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def hashing_embedder(size: int = 64) -> Callable[[], Model]:
    """An embedder without a model, for tests and runs: signed counts of hashed words, at length 1."""
    return partial(_hashing, size)


def _hashing(size: int) -> Model:
    return partial(_hashed, size=size)


def in_batches(texts: list[str], model: Model, batch: int = BATCH) -> np.ndarray:
    """Vectors of texts, the texts going to the model in order of their lengths, `batch` in a call."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out: np.ndarray | None = None
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        vectors = np.asarray(model([texts[i] for i in some]))
        if vectors.shape[0] != len(some):
            raise ValueError(f"{vectors.shape[0]} vectors for {len(some)} texts")
        out = np.zeros((len(texts), vectors.shape[1]), np.float32) if out is None else out
        out[some] = vectors
    return np.zeros((0, 0), np.float32) if out is None else out


def embedded(df: DataFrame, text_col: str, load: Callable[[], Model], name: str, *, out: str = "embedding", prefix: str = "", batch: int = BATCH) -> DataFrame:
    """df with the vectors of its texts (arrays of float); a null text has none.

    name: of the model, for the workers.  Rows are gathered across Arrow batches, so calls are full and
    of about one length; rows of long texts only up to a number of bytes.  A column of the name of the new
    one is replaced.
    """
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.FloatType()))])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, n, size = loaded(name, load), [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            texts = [t for b in held for t in b.column(at).to_pylist()]
            there = [i for i, t in enumerate(texts) if t is not None]
            vectors = in_batches([prefix + texts[i] for i in there], model, batch)
            place, start = dict(zip(there, range(len(there)), strict=True)), 0
            for b in held:
                own = [vectors[place[i]] if i in place else None for i in range(start, start + b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.float32()))], names=schema.names)
                start += b.num_rows

        for b in batches:
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
            if n >= batch * AHEAD or size >= HELD_BYTES:
                yield from done()
                held, n, size = [], 0, 0
        if held:
            yield from done()

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def embedded_anew(store: DataFrame, texts: DataFrame, key: str, text_col: str, load: Callable[[], Model], name: str, **options) -> DataFrame:
    """The store brought up to the texts and the model: key, doc_hash, model and embedding of each text.

    store: rows of an earlier run in those columns.  Its vectors stay where text and model are the
    same; only new and changed texts go to the model; rows whose key has no text any more go.
    """
    now = texts.where(F.col(text_col).isNotNull()).select(key, text_col, F.sha2(text_col, 256).alias("doc_hash"))
    had = store.where(F.col("model") == name).select(F.col(key).alias("_key"), F.col("doc_hash").alias("_hash"), "embedding")
    joined = now.join(had, (F.col(key) == F.col("_key")) & (F.col("doc_hash") == F.col("_hash")), "left")
    same = joined.where("embedding IS NOT NULL").select(key, "doc_hash", F.lit(name).alias("model"), "embedding")
    changed = embedded(joined.where("embedding IS NULL").select(key, text_col, "doc_hash"), text_col, load, name, **options)
    return same.unionByName(changed.select(key, "doc_hash", F.lit(name).alias("model"), "embedding"))


def rewrite_store(spark: SparkSession, path: str, to: str, load: Callable[[], Model], name: str, *, text_col: str = "document", **options) -> DataFrame:
    """A store (Parquet by batch, with ids, documents and metadata) with all embeddings of a model, at another path; what the store had is left as it is."""
    rows = spark.read.parquet(path)
    embedded(rows, text_col, load, name, **options).write.mode("overwrite").partitionBy("batch").parquet(to)
    return spark.read.parquet(to)
