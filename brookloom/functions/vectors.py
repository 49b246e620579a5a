"""Vectors as arrays: products, norms, alignment, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def unit(a: Column) -> Column:
    """a at length 1; zeros stay zeros."""
    # the norm is bound once, as the element of an array
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))), 0)


def aligned(a: Column, n: int) -> Column:
    """The first n numbers, zeros added where there are fewer."""
    return F.when(F.size(a) >= n, F.slice(a, 1, n)).otherwise(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), F.lit(n) - F.size(a))))


def usable(df: DataFrame, embedding: str, size: int | None) -> DataFrame:
    """Rows whose vector is there, holds no null and has the one size; without `size`, several sizes are an error."""
    whole = df.where(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull()))
    if size is not None:
        return whole.where(F.size(embedding) == size)
    ends = whole.agg(F.min(F.size(embedding)).alias("least"), F.max(F.size(embedding)).alias("most")).first()
    if ends["least"] != ends["most"]:
        raise ValueError(f"vectors of {ends['least']} to {ends['most']} numbers: name the size that counts")
    return whole


#: Queries and corpus rows of a tile: what a task multiplies at once, whatever the sizes of both sides and of Arrow's batches.
TILE_QUERIES, TILE_ROWS = 512, 2048


def _better(best_s: np.ndarray, best_i: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
    """Put the rows of a tile that are better into the best so far, in place: best first, ties by the smaller id."""
    k = best_s.shape[1]
    edge = best_s[:, -1]
    if sims.shape[1] > k and np.isneginf(edge).any():
        edge = np.maximum(edge, np.partition(sims, -k, axis=1)[:, -k])
    row, col = np.nonzero(sims >= edge[:, None])
    if not len(row):
        return
    some, at = np.unique(row, return_inverse=True)
    of = np.concatenate((np.repeat(np.arange(len(some)), k), at))
    s, i = np.concatenate((best_s[some].ravel(), sims[row, col])), np.concatenate((best_i[some].ravel(), ids[col]))
    order = np.lexsort((i, -s, of))
    counts = np.bincount(of, minlength=len(some))
    kept = order[np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) < k]
    best_s[some], best_i[some] = s[kept].reshape(-1, k), i[kept].reshape(-1, k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, size: int | None = None, digits: int = 6, block: int = 4096) -> DataFrame:
    """query_id, vec_id, sim and rank of the k most similar corpus rows of each query.

    queries and corpus have id and embedding.  The queries are a stated set that is collected in blocks;
    the corpus streams past each block as matrix products in tiles of bounded size, each task keeps its k
    best of each query, and only those meet in a window.  So the corpus is neither shuffled nor multiplied
    out.  Rows without an embedding, or with a null in it, are near nothing and are left out, as are those
    of another length than `size`; without it, queries of several lengths are an error.  NaN is above all
    numbers, as in SQL.  For two large sets see `nearest`.
    """
    out = None
    held: list = []
    queries = usable(queries, "embedding", size)
    whole = corpus.select("id", "embedding").where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("sim", T.DoubleType())])

    def scan(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_s, best_i = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
            for b in batches:
                for part in (b.slice(at, TILE_ROWS) for at in range(0, b.num_rows, TILE_ROWS)):
                    own = np.asarray(part.column("id"), np.int64)
                    x = np.asarray(part.column("embedding").flatten(), np.float64).reshape(len(own), -1)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    for s in range(0, len(q), TILE_QUERIES):
                        sims = np.round(q[s : s + TILE_QUERIES] @ x.T, digits)
                        sims[np.isnan(sims)] = np.inf
                        _better(best_s[s : s + TILE_QUERIES], best_i[s : s + TILE_QUERIES], sims, own)
            query, rank = np.nonzero(best_s > -np.inf)
            sims = best_s[query, rank]
            sims[np.isinf(sims)] = np.nan
            yield pa.RecordBatch.from_arrays([pa.array(ids[query], pa.int64()), pa.array(best_i[query, rank], pa.int64()), pa.array(sims, pa.float64(), from_pandas=False)], names=schema.names)

        return whole.where(F.size("embedding") == q.shape[1]).mapInArrow(run, schema)

    for row in queries.select("id", "embedding").where("id IS NOT NULL").toLocalIterator():
        held.append((row["id"], row["embedding"]))
        if len(held) == block:
            out = scan(held) if out is None else out.union(scan(held))
            held = []
    if held:
        out = scan(held) if out is None else out.union(scan(held))
    if out is None:
        out = queries.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def projection(size: int, to: int, seed: int) -> np.ndarray:
    """A Gaussian matrix of a seed, with deviation 1 / sqrt(to)."""
    return np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(to), (size, to))


def projected(a: Column, size: int, to: int, seed: int) -> Column:
    """The first `size` numbers of a, zeros added, times a projection of a seed."""
    matrix = projection(size, to, seed)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def multiply(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else [float(y) for y in np.asarray(x, float) @ matrix])

    return multiply(aligned(a, size))


def mean_cosines(df: DataFrame, label: str, embedding: str) -> DataFrame:
    """a, b and the mean cosine of all pairs of a vector of label a and one of label b: the product of the labels' mean unit vectors, in one aggregation."""
    long = df.where(F.col(embedding).isNotNull()).select(F.col(label).alias("label"), F.posexplode(unit(F.col(embedding))).alias("at", "x"))
    means = long.groupBy("label", "at").agg(F.avg("x").alias("m"))  # a row for each label and place
    pairs = means.select(F.col("label").alias("a"), "at", F.col("m").alias("ma")).join(means.select(F.col("label").alias("b"), "at", F.col("m").alias("mb")), "at")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("v"))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """An embedding without a model, for tests and runs: signed counts of hashed words, at length 1."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    each = lambda i: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == i, F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), each))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask (0 or 1) keeps, at length 1."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m > 0, t)), lambda t: t.isNotNull())
    total = F.aggregate(F.slice(kept, 2, 1 << 30), F.get(kept, 0).cast("array<double>"), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return unit(F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9))))


def fused(ranked: DataFrame, weight: float = 1.0, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: id and score, summed over all lists it stands in."""
    return ranked.groupBy("query_id", "vec_id").agg(F.sum(F.lit(weight) / (c + F.col("rank"))).alias("score"))
