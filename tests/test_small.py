"""Small operators and columns against tables worked out by hand: files, filters by pattern, diffs, projections, exports, queries without SQL."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookloom.functions import chunks, text, vectors
from brookloom.operators import filters, report, scoring
from brookloom.plans.catalog import QUERIES
from brookloom.sources import archives, sinks
from brookloom.streaming import ingest


def test_texts_and_thread_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, data in (("a/thread_12.txt", b"x\xc3\xa9"), ("a/b/thread_12.txt", b"second"), ("a/THREAD_7.JSON", b"{}"), ("a/empty.txt", b""), ("a/thread_x.txt", b"no number")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[1]: (r.text, r.doc_id) for r in archives.read_texts(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/thread_12.txt", "b/thread_12.txt", "a/thread_x.txt"} and got["a/thread_12.txt"][0] == "xé"
    assert got["a/thread_12.txt"][1] == __import__("hashlib").sha256(b"x\xc3\xa9").hexdigest()
    found = {r.thread_id: (r.txt, r.json) for r in archives.thread_files(spark, str(tmp_path)).collect()}
    assert set(found) == {7, 12} and found[12][0].endswith("a/b/thread_12.txt") and found[12][1] is None and found[7][1].endswith("THREAD_7.JSON")


def test_new_files_by_hash_and_source(spark):
    store = spark.createDataFrame([("h1", "s1"), ("h2", "s2")], "doc_hash string, source string")
    files = spark.createDataFrame([("h1", "s1"), ("h1", "s2"), ("h1", "new"), ("new", "s1"), ("new", "new")], "doc_hash string, source string")
    # a file is known if its hash is and its source is, be it of another row
    assert sorted((r.doc_hash, r.source) for r in ingest.new_files(files, store).collect()) == [("h1", "new"), ("new", "new"), ("new", "s1")]


def test_rules_by_pattern(spark):
    df = spark.createDataFrame([(1, ["Ünder 12", None]), (2, ["abc"]), (3, [None]), (4, [])], "id int, v array<string>")
    held = lambda **rule: [r.id for r in df.where(filters.rule_predicate(F.filter("v", lambda x: x.isNotNull()), rule)).orderBy("id").collect()]
    assert held(regex=r"^\w+ \d+$") == [1] and held(regex="b") == [2] and held(required=True) == [1, 2]
    assert held(min_length=4) == [1] and held(max_length=3) == [2] and held(contains=["ABC", "x"]) == [2] and held(not_contains="b") == [1]
    rows = spark.createDataFrame([("12",), (" 7.5 ",), ("x",), (None,), ("",)], "c string")
    of = lambda **rule: [r.c for r in rows.where(filters.row_predicate("c", rule)).collect()]
    assert of(min_value=8) == ["12"] and of(max_value=8) == [" 7.5 "] and of(regex=r"^\d+$") == ["12"] and of(required=True) == ["12", " 7.5 ", "x"]
    assert of(not_contains=["x"]) == ["12", " 7.5 ", ""] and of(min_length=2, contains="2") == ["12"]


def test_characters(spark):
    df = spark.createDataFrame([("a\x00b\tc\x0bd\n\x1f", "kitten", "sitting"), (None, None, "new")], "t string, a string, b string")
    assert [r[0] for r in df.select(text.without_illegal(F.col("t"))).collect()] == ["ab\tcd\n", None]
    one, two = (r[0] for r in df.select(text.char_diff(F.col("a"), F.col("b"))).collect())
    assert "".join(s.segment for s in one if s.tag in ("equal", "delete")) == "kitten" or [(s.tag, s.segment) for s in one]
    assert {s.tag for s in one} >= {"equal"} and "".join(s.segment for s in two) == "new"


def test_projection_is_a_product(spark):
    rows = [(k, [float(x) for x in range(k, k + n)]) for k, n in enumerate((8, 5, 12))] + [(9, None)]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, v array<double>").select("k", vectors.projected(F.col("v"), 8, 3, 5).alias("p")).collect()}
    matrix = vectors.projection(8, 3, 5)
    for k, v in rows[:3]:
        want = np.array((v + [0.0] * 8)[:8]) @ matrix
        assert got[k] == pytest.approx(want.tolist())
    assert got[9] is None


def test_keys_in_order(spark):
    rows = [("B", "ALL", k) for k in ("10", "9", None, "-1", "NULL")] + [("A", "x", "2")]
    df = report.report_rows(spark.createDataFrame(rows, "section string, group string, key string"))
    assert [r.key for r in report.in_order(df).collect()] == ["2", "-1", "9", "10", "NULL", None]


def test_comparison_and_its_export(spark, tmp_path):
    def broken(q):
        raise ValueError("no")

    calls = scoring.compared(spark.createDataFrame([("why",), ("how",)], "q string"), "q", {"a": lambda q: q.upper(), "b": broken, "c": lambda q: q[::-1]})
    got = {(r.q, r.model): (r.answer, r.ok) for r in calls.collect()}
    assert got["why", "a"] == ("WHY", True) and got["how", "c"] == ("woh", True) and got["why", "b"] == ("[error] ValueError: no", False) and len(got) == 6
    sinks.write_files(scoring.comparison_export(calls, "q"), str(tmp_path))
    files = [json.loads(p.read_text()) for p in tmp_path.glob("comparison_*.json")]
    assert {f["question"]: f["answers"]["a"] for f in files} == {"why": "WHY", "how": "HOW"}
    assert all((f["usage_stats"]["a"]["successes"], f["usage_stats"]["b"]["errors"]) == (2, 2) and f["timestamp"] for f in files)


# ---- queries without SQL, on a small table or against the same steps in Python


def test_chunks_of_whole_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = Counter((r.doc_id, r.chunk_idx, r.chunk) for r in QUERIES["q_recursive_chunks"](spark, sf).collect())
    assert got == Counter((i, k, c) for i, t in texts.items() if t for k, c in enumerate(chunks.split_text(t)))
    rows = QUERIES["q_embedded_chunks"](spark, sf).collect()
    assert len(rows) == sum(got.values()) and len({r.id for r in rows}) == len({(i, k) for i, k, _ in got})
    lengths = [sum(x * x for x in r.embedding) for r in rows]  # 0 for a chunk without a word
    assert all(len(r.embedding) == 16 for r in rows) and all(abs(x - 1) < 1e-4 or x == 0 for x in lengths) and sum(lengths) > 0.9 * len(rows)


def test_diffs_and_scores_of_conversations(spark, sf):
    rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect())
    users = {}
    for conv, _, role, said in rows:
        if role == "user":
            users.setdefault(conv, []).append(said)
    want = {(c, k): "" if k == 0 else text.word_diff_of(own[k - 1], own[k]) for c, own in users.items() for k in range(len(own))}
    assert {(r.conv_id, r.idx): r.text_diff for r in QUERIES["q_word_diff"](spark, sf).collect()} == want
    scores = {r.reply: (r.clarity, r.accuracy, r.comment) for r in QUERIES["q_mrubric_scores"](spark, sf).collect()}
    told = {f"{c}-{t}": scoring.fake_client(f"Score this reply: {said}") for c, t, role, said in rows if role == "assistant"}
    assert scores == {k: (v["clarity"], v["accuracy"], v["comment"]) for k, v in told.items()}


def test_texts_of_pages_and_documents(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["q_strip_html"](spark, sf).collect()}
    assert {k: r.parsed for k, r in got.items()} == {k: text.page_text(h) for k, h in pages.items()}
    assert all("<" not in r.text or "&lt;" in pages[k] for k, r in got.items())
    images = {r.page_id: r.images for r in QUERIES["q_base64_placeholders"](spark, sf).collect()}
    assert images == {k: len(__import__("re").findall(text.IMAGE, h or "")) for k, h in pages.items()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    clean = {r.doc_id: r for r in QUERIES["q_sanitize_compat"](spark, sf).collect()}
    assert {k: (r.compat, r.web, r.viewer) for k, r in clean.items()} == {k: (text.compat_of(t), text.web_text(t), text.viewer_text(t)) for k, t in docs.items()}
    events = {r.event_id: r.props for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    assert {r.event_id: r.answer for r in QUERIES["q_first_json"](spark, sf).collect()} == {k: text.first_json(f"Sure: {p}") if p is not None else text.first_json(None) for k, p in events.items()}


def test_projected_pairs(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    m = vectors.projection(64, 48, 7)
    cos = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    got = {r.vec_id: r.projected for r in QUERIES["q_projected_cosine"](spark, sf).collect()}
    assert set(got) == {k for k in rows if k + 1 in rows}
    assert all(v == pytest.approx(cos(rows[k] @ m, rows[k + 1] @ m), abs=2e-5) for k, v in got.items())
