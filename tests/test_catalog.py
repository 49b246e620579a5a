"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math

import duckdb
import pytest

from brookloom.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def test_scans_are_pruned(spark, sf):
    plan = QUERIES["q_outer_to_inner"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    assert "LeftOuter" not in plan
