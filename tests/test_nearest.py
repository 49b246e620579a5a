"""Nearest neighbours by pivots against all products, and how much the bounds save."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookloom.functions import vectors
from brookloom.operators import nearest
from brookloom.plans.catalog import QUERIES

SCHEMA = "id long, group int, embedding array<float>"


def clustered(n, centres, seed=0, size=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size)) * 3
    return (middle[rng.integers(0, centres, n)] + 0.1 * rng.normal(size=(n, size))).astype(np.float32)


def brute(qs, groups, xs, of, k):
    unit = lambda v: v.astype(np.float64) / np.maximum(np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True), 1e-12)
    sims, out = np.round(unit(qs) @ unit(xs).T, 6), {}
    for q in range(len(qs)):
        for g in groups[q]:
            own = sorted((-sims[q, i] + 0.0, i) for i in range(len(xs)) if of[i] == g)[:k]
            out.update({(q, g, r + 1): (i, round(-s, 6) + 0.0) for r, (s, i) in enumerate(own)})
    return out


@pytest.mark.parametrize(("k", "block", "pivots"), [(1, 4096, 1024), (1, 10, 30), (3, 7, 12)])
def test_neighbours_are_brute_force(spark, k, block, pivots):
    rng = np.random.default_rng(k)
    xs = np.concatenate([clustered(150, 8), rng.normal(size=(60, 12)).astype(np.float32), np.zeros((2, 12), np.float32)])
    xs[5] = xs[3]  # a tie
    of = [i % 3 for i in range(len(xs))]
    groups = [[g for g in range(4) if g >= of[i]] for i in range(len(xs))]
    corpus = spark.createDataFrame([(i, of[i], xs[i].tolist()) for i in range(len(xs))], SCHEMA)
    queries = spark.createDataFrame([(i, xs[i].tolist(), groups[i]) for i in range(len(xs))], "id long, embedding array<float>, groups array<int>")
    got = {(r.query_id, r.group, r["rank"]): (r.id, round(r.sim, 6) + 0.0) for r in nearest.nearest(queries, corpus, k, block=block, pivots=pivots).collect()}
    assert got == brute(xs, groups, xs, of, k)


def test_null_and_ragged_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 1, [0.5, 0.5]), (3, 1, None), (4, 1, [1.0, None]), (5, 0, [0.0, 0.0]), (None, 1, [1.0, 0.0]), (6, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.a, r.b, r.id): round(r.sim, 4) for r in nearest.label_nearest(df, "id", "group", "embedding").collect()}
    assert got == {(0, 0, 1): 1.0, (0, 1, 1): 0.7071, (0, 0, 5): 0.0, (0, 1, 5): 0.0, (1, 1, 2): 1.0}
    ragged = df.union(spark.createDataFrame([(9, 1, [1.0])], SCHEMA))
    with pytest.raises(ValueError, match="name the size"):
        nearest.label_nearest(ragged, "id", "group", "embedding")
    assert {(r.a, r.b, r.id) for r in nearest.label_nearest(ragged, "id", "group", "embedding", size=2).collect()} == set(got)
    with pytest.raises(ValueError, match="name the size"):
        vectors.top_k(ragged, df, 1)
    assert sorted({r.query_id for r in vectors.top_k(ragged, df, 1, size=2).collect()}) == [1, 2, 5, 6]
    assert nearest.label_nearest(df.where("false"), "id", "group", "embedding").collect() == []


def test_work_in_clusters_is_far_below_square(spark):
    """Rows that the queries meet, of all pairs, at two sizes."""
    share = {}
    for n in (1000, 4000):
        xs = clustered(n, 40, seed=4)
        rows = spark.createDataFrame([(i, 0, xs[i].tolist()) for i in range(n)], SCHEMA)
        met = nearest.visits_of(rows.select("id", "embedding", F.array(F.lit(0)).alias("groups")), rows, block=25, pivots=100)
        share[n] = met / n**2
    assert share[1000] < 0.2 and share[4000] < 0.2


def test_drift_plan_has_no_nested_loop(spark, sf):
    plan = QUERIES["q_drift_nearest"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
