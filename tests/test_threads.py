"""Searches of threads and submissions, pages, drift tables, verdicts by file, ensured files, and small columns."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from brookloom.functions import chunks, text
from brookloom.operators import drift, filters, judge, report, threads
from brookloom.sources import archives

SUBS = "thread_id long, k int, short_answer string, long_answer string, response string, school_name string, strategy int, clarity int, mentor_name string, puzzle_text string"
ROWS = [
    (10, 2, "abcd", "x" * 30, "  \n", "Late", None, None, "Ann", "Puzzle A"),
    (10, 1, "ab", None, "reply", "First", 1, None, "Ann", "Puzzle A"),
    (21, 1, None, "<img SRC='DATA:image/png;base64,AA'>", None, None, None, None, None, "other"),
    (31, 1, "data:image;base64,AA", "base64, is a word", "ok", "East", 0, 2, "Bob", "Puzzle B"),
]


def metrics(spark):
    return threads.thread_metrics(spark.createDataFrame(ROWS, SUBS), "thread_id", "k", ["strategy", "clarity"], carry=["mentor_name", "puzzle_text"])


def test_metrics(spark):
    got = {r.thread_id: r for r in metrics(spark).collect()}
    names = ["num_subs", "num_rubrics", "num_mentor_msgs", "median_short", "median_long", "median_mentor", "has_images", "school_name"]
    assert [got[10][n] for n in names] == [2, 1, 1, 3.0, 15.0, 4.0, False, "First"]
    assert [got[21][n] for n in names] == [1, 0, 0, 0.0, 36.0, 0.0, True, "Unknown"]
    assert got[31].has_images is False  # a type is missing


@pytest.mark.parametrize(("asked", "want"), [
    ({}, {10, 21, 31}), ({"thread_id": "1"}, {10, 21, 31}), ({"thread_id": "31 "}, {31}), ({"puzzle_text": "PUZZLE"}, {10, 31}), ({"mentor_name": "an"}, {10}), ({"school_name": "unk"}, {21}),
    ({"num_subs": "2"}, {10}), ({"num_mentor_msgs": "1"}, {10, 31}), ({"num_rubrics": "1"}, {10, 31}), ({"median_short": "3"}, {10, 31}), ({"median_long": "16"}, {21, 31}), ({"median_mentor": "3"}, {10}),
    ({"num_subs": "two"}, set()), ({"median_long": "1.5"}, set()), ({"has_images": "yes"}, {21}), ({"has_images": "NO"}, {10, 31}), ({"has_images": "maybe"}, {10, 21, 31}),
    ({"has_feedback": "yes"}, {10}), ({"has_feedback": "no", "puzzle_text": "puzzle"}, {31}), ({"num_subs": "  "}, {10, 21, 31})])
def test_search(spark, asked, want):
    feedback = spark.createDataFrame([(10,), (10,), (99,)], "thread_id long")
    assert sorted(r.thread_id for r in threads.searched(metrics(spark), asked, feedback).collect()) == sorted(want)


def test_search_of_what_is_not_there(spark):
    with pytest.raises(ValueError, match="unknown"):
        threads.searched(metrics(spark), {"color": "x"})


def test_pages(spark):
    df = spark.range(23)
    for asked, page, rows in ((1, 1, range(10)), (3, 3, range(20, 23)), (9, 3, range(20, 23)), (-4, 1, range(10))):
        found, *numbers = threads.page_of(df, ["id"], asked, 10)
        assert [r.id for r in found.collect()] == list(rows) and numbers == [23, page, 3]
    assert threads.page_of(df.where("false"), ["id"], 2, 10)[1:] == (0, 1, 1)


def test_submission_search(spark):
    rows = [(11, "P one", "Yes", "l", "r", [("x")], 2, None), (12, "p two", "no", "", "r", [], 4, 1), (3, "q", None, "l", "r", None, None, None)]
    df = spark.createDataFrame(rows, "submission_id long, puzzle_text string, short_answer string, long_answer string, response string, images array<string>, strategy int, clarity int")
    of = lambda **asked: {r.submission_id for r in threads.submissions_like(df, asked, ["strategy", "clarity"]).collect()}
    assert of() == {11, 12, 3} and of(id="1") == {11, 12} and of(puzzle="P ") == {11, 12} and of(short_answer="YE") == {11}
    assert of(images="y") == {11} and of(images="N") == {12, 3} and of(min_score="2.5") == {12} and of(min_score="much") == set()
    assert of(filled="Y") == {11} and of(filled="n") == {12, 3} and of(filled="?") == {11, 12, 3}


def test_fields_fall_back_to_scores(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('clarity', CAST(NULL AS INT), 'rubrics', named_struct('clarity', 3)), named_struct('clarity', 1, 'rubrics', named_struct('clarity', 9))) AS conversation")
    assert df.select(filters.values_of("clarity", [], ["clarity"], ["clarity"])).first()[0] == ["3", "1"]


def test_drift_files_are_written_once(spark, tmp_path):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [1.0, 1.0]), (3, "c", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label string, embedding array<float>")
    folder = str(tmp_path / "drift")
    assert drift.write_drift(df.where("label < 'c'"), "id", "label", "embedding", folder) is True
    assert drift.write_drift(df.where("label < 'c'"), "id", "label", "embedding", folder) is False  # complete
    assert drift.missing_pairs(spark, f"{folder}/embedding_shift_pairs.csv", ["a", "b", "c"]) == [("a", "c"), ("b", "c"), ("c", "c")]
    assert drift.write_drift(df, "id", "label", "embedding", folder) is True
    table = {(r["A"], r["B"]): (round(float(r["mean_cosine"]), 4), round(float(r["relative_drift_pct"]), 2)) for r in csv.DictReader(open(f"{folder}/embedding_shift_pairs.csv"))}
    assert table == {("a", "a"): (1, 0), ("a", "b"): (0.7071, 29.29), ("a", "c"): (-0.5, 150), ("b", "b"): (1, 0), ("b", "c"): (-0.7071, 170.71), ("c", "c"): (1, 0)}
    matrix = list(csv.reader(open(f"{folder}/embedding_shift_matrix.csv")))
    assert matrix[0] == ["", "a", "b", "c"] and matrix[2][1] == matrix[1][2]
    open(f"{folder}/embedding_shift_pairs.csv", "w").write("A,B\na,a\n")
    assert len(drift.missing_pairs(spark, f"{folder}/embedding_shift_pairs.csv", ["a", "b"])) == 3  # other columns


def test_a_verdict_for_each_file(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, words in (("a.txt", "good"), ("deep/b.txt", "silent"), ("c.v2.txt", "lost"), ("d.json", "x"), ("deep/a.txt", "second of a name")):
        (tmp_path / "in" / name).write_text(words)

    def say(prompt):
        if "lost" in prompt:
            raise ValueError("no line")
        return "nothing" if "silent" in prompt else 'Here: {"scores": {"Clarity": 3, "Cognitive Demand": 4}, "justification": "because"} ok'

    judge.judge_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), say, "You judge.", tries=1)
    got = {p.name: json.loads(p.read_text()) for p in (tmp_path / "out").iterdir()}
    assert got["a.json"] == {"scores": {"Clarity": 3, "Cognitive Demand": 4}, "justification": "because"}
    assert got["b.json"] == {"error": "No JSON found in response", "raw": "nothing"}
    assert set(got) == {"a.json", "b.json", "c.v2.json"} and "no line" in got["c.v2.json"]["error"]


def test_needed_files_are_made(spark, tmp_path):
    (tmp_path / "thread_1.txt").write_text("there")
    (tmp_path / "thread_3.json").write_text("{}")
    make = lambda df: df.select(F.format_string("thread_%d.txt", "thread_id").alias("path"), F.format_string("made %d", "thread_id").alias("content"))
    got = archives.ensured_files(spark, spark.createDataFrame([(1,), (2,), (2,), (3,)], "thread_id long"), str(tmp_path), make)
    assert sorted((r.thread_id, r.path.rsplit("/", 1)[1]) for r in got.collect()) == [(k, f"thread_{k}.txt") for k in (1, 2, 3)]
    assert [(tmp_path / f"thread_{k}.txt").read_text() for k in (1, 2, 3)] == ["there", "made 2", "made 3"]


def test_windows_of_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two three " * 20, "", None, "short"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").select("id", chunks.tokenized(F.col("text"), path).alias("ids"))
    got = {(r.id, r.chunk_idx): r.chunk for r in chunks.token_chunks(df, "ids", 16, 8).collect()}
    library = Tokenizer.from_file(path)
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if t}
    assert {k for k, _ in got} == set(ids)
    assert all(c == ids[k][8 * j : 8 * j + 16] for (k, j), c in got.items())
    assert all(sum(i == k for i, _ in got) == max(1, -(-(len(x) - 8) // 8)) for k, x in ids.items())


def test_small_columns(spark):
    df = spark.createDataFrame([(" long ", "s"), (" ", " short\n"), (None, "s"), ("", None)], "l string, s string")
    assert [r[0] for r in df.select(text.chosen_answer(F.col("l"), F.col("s"))).collect()] == ["long", "short", "s", None]
    assert text.shortened(list("abcdef"), 0) == list("abcdef") and text.shortened(list("abcdef"), 1) == ["a", "...", "f"]
    numbers = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),), (3.0,), (None,)], "v double")
    assert sorted(map(tuple, report.histogram(numbers, "v", 2).collect())) == [(0, 1, 0.333333), (1, 2, 0.666667)]
