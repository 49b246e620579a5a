"""What a task holds at once, and what is shuffled, on inputs that would show growth."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from brookloom.functions import vectors
from brookloom.operators import embedding, nearest
from brookloom.plans.catalog import QUERIES
from brookloom.sources.tables import table

SCHEMA = "id long, embedding array<float>"


def test_a_search_holds_tiles_and_finds_all(spark, monkeypatch):
    """Many queries and one large Arrow batch: memory stays that of tiles (before: six times queries x rows), the rows those of a full sort."""
    rng = np.random.default_rng(3)
    n, q, k = 6000, 1500, 5
    xs = rng.normal(size=(n, 8)).astype(np.float32)
    xs[10], xs[11] = xs[4000], xs[4000]  # ties
    df = spark.createDataFrame([(i, xs[i].tolist()) for i in range(n)], SCHEMA)
    held = []
    plain = type(df).mapInArrow

    def kept(self, run, schema, *more):
        held.append(run)
        return plain(self, run, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", kept)
    got = vectors.top_k(df.where(f"id < {q}"), df, k)
    unit = lambda v: v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    sims = np.round(unit(xs[:q]) @ unit(xs).T, 6)
    order = np.lexsort((np.broadcast_to(np.arange(n), sims.shape), -sims), axis=1)[:, :k]
    assert {(r.query_id, r["rank"]): (r.vec_id, round(r.sim, 6)) for r in got.collect()} == {(a, r + 1): (int(i), round(float(sims[a, i]), 6)) for a in range(q) for r, i in enumerate(order[a])}

    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(xs.tolist(), pa.list_(pa.float32()))], names=["id", "embedding"])
    tracemalloc.start()
    list(held[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * q * 8, peak


def test_a_search_of_nan_and_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [0.0, 0.0])], SCHEMA)
    got = [(r.vec_id, r["rank"]) for r in vectors.top_k(df.where("id = 1"), df, 5).orderBy("rank").collect()]
    assert got == [(2, 1), (1, 2), (3, 3)]


def test_texts_come_in_small_batches(spark, tmp_path):
    """A UDF on a table of long texts gets some 4 MB at once (before: up to 10,000 rows, here all 24 MB)."""
    spark.range(3000).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), 8000).alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    held = F.pandas_udf(lambda s: pd.Series([int(s.str.len().sum())] * len(s)), "long")
    own = spark.newSession()  # its settings are Spark's
    most = table(own, str(tmp_path), "pages").select(held("html").alias("n")).agg(F.max("n")).first()[0]
    assert most < 8 << 20, most


def test_queries_go_to_a_shelf_once(spark):
    """Where no bound holds, a query is shuffled once for each shelf in each step (before: once for each of some 40 blocks), and both sides of a task are bounded."""
    rng = np.random.default_rng(8)
    n = 2000
    rows = spark.createDataFrame([(i, 0, rng.normal(size=16).astype(np.float32).tolist()) for i in range(n)], "id long, group int, embedding array<float>")
    _, visitors, blocks = nearest._searched(rows.select("id", "embedding", F.array(F.lit(0)).alias("groups")), rows, 1, block=50, pivots=40)
    assert visitors.count() <= 2 * n
    assert blocks.count() == n and blocks.select("shelf").distinct().count() == 1


def test_small_shelves_and_parts_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, i % 2, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)], "id long, group int, embedding array<float>")
    queries = rows.select("id", "embedding", F.array(F.lit(0), F.lit(1)).alias("groups"))
    found = lambda: sorted((r.query_id, r.group, r["rank"], r.id, round(r.sim, 6)) for r in nearest.nearest(queries, rows, 3, block=20, pivots=6).collect())
    whole = found()
    monkeypatch.setattr(nearest, "SHELF_BYTES", 16 * 50)  # 50 vectors
    assert found() == whole and len(whole) == 300 * 2 * 3


def test_drift_searches_once(spark, sf):
    """Before: the search stood twice in the plan, for the means and for those of a label with itself."""
    plan = QUERIES["q_drift_nearest"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") in (2, 3), plan  # bounds, and the first and other blocks


def test_an_embedder_gathers_few_long_texts(spark, monkeypatch):
    """Rows are gathered for calls of one length up to some 8 MB (before: up to 4,096 rows, here all 40 MB); all come back in order."""
    held = []
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema, *more: held.append(run))
    embedding.embedded(df, "t", embedding.hashing_embedder(4), "bounds-4")
    drawn = []

    def batches():
        for k in range(40):
            drawn.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(range(50 * k, 50 * k + 50), pa.int64()), pa.array([f"{k} " + "x" * 20_000] * 50)], names=["id", "t"])

    out = held[0](batches())
    first = next(out)
    assert len(drawn) <= 9, drawn
    ids = [i for b in (first, *out) for i in b.column("id").to_pylist()]
    assert ids == list(range(2000)) and first.column("embedding").null_count == 0
