"""Fill-in-the-middle examples: brute force, SQL, other units and rates, odd rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from brookloom.llm import fill_middle
from brookloom.llm.queries import ORACLE_SQL, QUERIES

TEXTS = [
    (1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "a\nb\n"), (6, "a\n\n\nb"), (7, "has <P> in it\nx"), (8, "<S>"), (9, "ends <\nS>\n<M"), (10, "🙂é\n中文\nlast"),
    (11, "x" * 300_000), (12, "y\n" * 20_000), (None, "null id\nb\nc"), (None, None), (5, "a\nb\n"), (5, "a\nb\n"), (13, "\r\n\r"), (14, "<P\n>S<\nM>"), (15, "z\nz\nz\nz\nz\nz"), (16, "1\n2\n3"), (17, "<\n<S\n<M<")]


def brute(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", rate=100, spm=50, seed=7):
    t = text or ""
    units = re.findall(pattern, t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, t
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "pattern", "rate", "spm", "seed"), [("line", r"[^\n]*\n|[^\n]+", 100, 50, 7), ("word", r"\s+|\S+", 60, 100, 1), ("char", r"(?s).", 100, 0, 2)])
def test_examples_are_brute_force(spark, unit, pattern, rate, spm, seed):
    rows = [r for r in TEXTS if unit == "line" or len(r[1] or "") < 1000]
    df = spark.createDataFrame([(i, t, "kept", "gone", 5) for i, t in rows], "doc_id long, text string, extra string, Form string, n long").repartition(3)
    found = fill_middle.fill_in_middle(df, unit=unit, rate=rate, spm=spm, seed=seed)
    assert found.columns == ["doc_id", "extra", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = found.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr)
    assert got == sorted((brute(i, t, pattern, rate, spm, seed) for i, t in rows), key=repr)
    assert all(r.again == r.text and r.extra == "kept" for r in found)


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES["op11_fill_middle"](spark, sf)
    want = con.sql(ORACLE_SQL["op11_fill_middle"])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_texts_move_once_and_no_python(spark, sf):
    plan = QUERIES["op11_fill_middle"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 4
