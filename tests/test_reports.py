"""The whole report on a table made by hand, and how it is planned."""

import re

import pytest
from pyspark.sql import functions as F

from brookloom.operators import report
from brookloom.plans.catalog import QUERIES

COLUMNS = "thread long, mentor_reply_count long, student_revisions long, scored_replies long, reply_seconds_median double, " + ", ".join(f"delta_{c} double" for c in report.RUBRIC) + ", delta_total double, service_name string, mentor_label string, school_name string"


def features(spark, rows):
    return spark.createDataFrame([(*r[:5], *r[5], sum(r[5]) if r[5][0] is not None else None, *r[6:]) for r in rows], COLUMNS)


NONE = (None,) * 6
ROWS = [
    (1, 0, 0, 0, None, NONE, None, "NULL", None),
    (2, 2, 1, 2, 5400.0, (1.0, 0.0, 0.0, 0.0, 0.0, -2.0), "", "7 - Ann", "East"),
    (3, 3, 1, 3, 9000.0, (2.0, 1.0, 0.0, 0.0, 0.0, 0.0), "puzzle", "7 - Ann", "East"),
    (4, 1, 2, 1, 100.0, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), "puzzle", "8", ""),
    (5, 5, 0, 2, -4000.0, (0.0, 0.0, 0.0, 0.0, 2.0, 0.0), "puzzle", "8", "West"),
]


def rows_of(df):
    return {(r.section, r.group, r.key, r.category, r.metric): (r["count"], r.percent, r.value) for r in df.collect()}


def test_report_by_hand(spark):
    df = report.whole_report(features(spark, ROWS))
    assert df.columns == list(report.COLUMNS)
    found = rows_of(df)
    of = lambda section: {k[1:4]: v[:2] for k, v in found.items() if k[0] == section}
    assert of("A. mentor_replies_distribution") == {("ALL", k, None): (1, 20.0) for k in "01235"}
    assert of("B. student_revisions_distribution") == {("ALL", "0", None): (2, 40.0), ("ALL", "1", None): (2, 40.0), ("ALL", "2", None): (1, 20.0)}
    # only threads with two scored replies; the total of thread 4 is left out here, but not in E
    assert of("C. total_score_improvement_distribution") == {("ALL", "-1", None): (1, 33.33), ("ALL", "3", None): (1, 33.33), ("ALL", "2", None): (1, 33.33)}
    assert of("E3. total_score_improvement_by_service") == {("NULL", "-1", None): (1, 100.0), ("puzzle", "3", None): (1, 33.33), ("puzzle", "0", None): (1, 33.33), ("puzzle", "2", None): (1, 33.33)}
    assert of("E7. mentor_replies_by_school")["NULL", "1", None] == (1, 50.0)
    assert of("E6_cat.delta_clarity_by_mentor") == {("7 - Ann", "0", None): (2, 100.0), ("8", "0", None): (1, 50.0), ("8", "2", None): (1, 50.0)}
    # hours: 1.5 to 2, 2.5 to 2, 0.03 to 0, -1.1 to -1; a thread without a reply isn't there
    assert of("F. time_to_reply_median_hours_distribution") == {("ALL", "2", None): (2, 50.0), ("ALL", "0", None): (1, 25.0), ("ALL", "-1", None): (1, 25.0)}
    # the share is of the positive counts: 2 + 1 + 1
    assert {k[2]: v for k, v in of("C. category_positive_improvement_share").items()} == {"strategy": (2, 50.0), "interpretation": (1, 25.0), "clarity": (1, 25.0), "accuracy": (0, 0.0), "completeness": (0, 0.0), "reflection": (0, 0.0)}
    metric = {(k[0], k[4]): v[2] for k, v in found.items() if k[4]}
    assert metric["C. scored_threads_summary", "threads_with_2plus_scored_responses"] == 3
    assert metric["C. total_score_improvement_summary", "mean_delta_total"] == 1.333
    assert metric["C. total_score_improvement_summary", "median_delta_total"] == 2
    assert metric["D. correlation_replies_vs_score_change", "n_pairs"] == 3
    assert metric["D. correlation_replies_vs_score_change", "pearson_r"] == pytest.approx(0.5766, abs=1e-4)  # (2, -1), (3, 3), (5, 2)
    assert metric["F. correlation_reply_time_vs_score_change", "n_pairs"] == 4


def test_report_without_threads(spark):
    found = rows_of(report.whole_report(features(spark, ROWS[:1]).where("false")))
    assert len(found) == 1 + 2 + 6 + 6
    assert all(v in ((None, None, 0.0), (None, None, None), (0, 0.0, None)) for v in found.values())
    assert found["D. correlation_revisions_vs_score_change", "ALL", None, None, "pearson_r"] == (None, None, None)


def test_two_middle_values_and_a_constant_side(spark):
    rows = [(k, 4, 0, 2, 60.0, (float(k), 0.0, 0.0, 0.0, 0.0, 0.0), "s", "m", "x") for k in (1, 2, 5, 9)]
    found = rows_of(report.whole_report(features(spark, rows)))
    assert found["C. total_score_improvement_summary", "ALL", None, None, "median_delta_total"][2] == 3.5
    assert found["D. correlation_replies_vs_score_change", "ALL", None, None, "pearson_r"][2] is None


def test_ordered_cells_are_shuffled_by_range_once(spark):
    df = report.whole_report(features(spark, ROWS), ordered=True)
    rows = df.collect()
    assert [tuple(r) for r in rows if r.metric or r.key] == [tuple(r) for r in report.in_order(report.whole_report(features(spark, ROWS))).collect() if r.metric or r.key]
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert len(re.findall(r"Exchange rangepartitioning", final)) == 1 and len(re.findall(r"Exchange hashpartitioning", final)) == 1  # window and order share the first


def test_thread_features_by_hand(spark):
    columns = "thread long, who string, reply int, ok boolean, at int, tie int, seconds double, a int, b int"
    rows = [
        (1, "x", 1, True, 3, 0, 30.0, 5, None), (1, "x", 2, True, 1, 0, 10.0, 2, 4), (1, "x", 3, False, 0, 0, 0.5, 9, 9), (1, "x", 4, None, 9, 0, None, 7, 7),
        (2, "y", 1, True, 1, 1, 8.0, 3, 1), (2, "y", 2, True, 1, 0, 2.0, 1, 1),
        (3, None, None, None, None, None, None, None, None), (4, "z", 1, False, 1, 0, -5.0, 1, 1),
    ]
    df = report.thread_features(
        spark.createDataFrame(rows, columns), "thread", reply=F.col("reply"), scored=F.col("ok"), order=[F.col("at"), F.col("tie")], seconds=F.col("seconds"),
        scores={"a": F.col("a"), "b": F.col("b")}, carry=["who"])
    got = {r.thread: (r.who, r.mentor_reply_count, r.scored_replies, r.reply_seconds_median, r.delta_a, r.delta_b, r.delta_total) for r in df.collect()}
    assert got == {1: ("x", 4, 2, 10.0, 3.0, -4.0, -1.0), 2: ("y", 2, 2, 5.0, 2.0, 0.0, 2.0), 3: (None, 0, 0, None, None, None, None), 4: ("z", 1, 0, -5.0, None, None, None)}
    assert "ObjectHashAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_each_table_is_read_once(spark, sf):
    df = QUERIES["q_base_report"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    for name in ("orders", "lineitem", "customer", "nation", "conversations"):
        assert len(re.findall(rf"FileScan parquet .*{name}\.parquet", final)) == 1, name


def test_members_and_archives_of_every_row(spark, tmp_path):
    import zipfile

    df = features(spark, ROWS)
    members = {}
    for r in report.report_members(df).collect():
        members.setdefault((r.section, r.group, r.key), set()).add(r.thread)
    found = rows_of(report.whole_report(df))
    counted = {(s, g, int(k)): n for (s, g, k, c, m), (n, _, _) in found.items() if k is not None and m is None and c is None}
    assert {k: len(v) for k, v in members.items()} == counted
    assert members["F. time_to_reply_median_hours_distribution", "ALL", 2] == {2, 3} and members["E3. total_score_improvement_by_service", "puzzle", 0] == {4}
    documents = spark.createDataFrame([(k, f"thread_{k}.{kind}", f"{kind} {k}") for k in (1, 2, 3) for kind in ("txt", "json")], "thread long, path string, content string")
    made = {r.archive: r.members for r in report.write_row_archives(df, documents, str(tmp_path)).collect()}
    name = "F. time_to_reply_median_hours_distribution_ALL_key_2.zip"
    assert made[name] == 4 and sorted(zipfile.ZipFile(tmp_path / name).namelist()) == ["thread_2.json", "thread_2.txt", "thread_3.json", "thread_3.txt"]
    assert len(made) == sum(bool(v & {1, 2, 3}) for v in members.values())
    assert report.write_row_archives(df, documents, str(tmp_path)).collect() == []  # they are there


def test_mrubric_rows_and_distributions(spark, tmp_path):
    from brookloom.operators import mrubric

    cats = ["concise", "curious"]
    replies = spark.createDataFrame([(k, k % 3, 1000 + k, f"reply {k}") for k in range(7)], "response_id long, thread_id long, response_date long, prompt string")
    threads = spark.createDataFrame([(0, 7, "7 - Ann", 2, 1, 1.5, " ", "East", 5400.0), (1, 8, "8", 0, 0, None, "s", None, None)], "thread_id long, mentor_user_id long, mentor_label string, mentor_reply_count long, student_revisions long, delta_total double, service_name string, school_name string, reply_seconds_median double")
    ask = lambda p: {"concise": len(p) % 3 + 0.9, "curious": None if p.endswith("1") else "2", "overall_comments": p} if not p.endswith("6") else None
    rows = mrubric.scored_rows(replies, threads, ask, str(tmp_path / "store"), cats, tries=1)
    assert rows.columns == [*mrubric.ROW, *cats, "overall_comments"]
    got = {r.response_id: r for r in rows.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5} and (got[0].concise, got[0].curious, got[1].curious) == (1, 2, None)
    assert got[2].mentor_label is None and got[3].reply_seconds_median == 5400.0 and got[3].overall_comments == "reply 3"
    mrubric.write_reports(rows, str(tmp_path / "out"), cats)
    table = {(r.report, r.bucket_value, r.factor_value, r.category, r.score_level): (r["count"], r.percent) for r in spark.read.parquet(f"{tmp_path}/out/distributions").collect()}
    assert table["by_mentor_label", None, "NULL", "curious", 2] == (2, 100.0) and table["by_school_name", None, "East", "concise", 1] == (2, 100.0)
    assert table["by_mentor_reply_count", "NULL", None, "curious", 2] == (2, 100.0) and table["by_mentor_reply_count", "0", None, "curious", 2] == (1, 100.0)
    assert ("by_student_revisions", "0", None, "curious", 2) not in table  # a thread without a reply
    assert table["by_delta_total", "2", None, "concise", 1] == (2, 100.0) and table["delta_total_x_service_name", "2", "NULL", "curious", 2] == (2, 100.0)
    assert table["mentor_reply_count_x_reply_time_bin", "2", "2", "curious", 2] == (2, 100.0)
    lines = [x for p in (tmp_path / "out" / "by_mentor_label").glob("*.csv") for x in p.read_text().splitlines()]
    assert lines[0] == "group_key,group_value,category,score_level,count,percent" and "mentor_label,8,concise,1,2,100.0" in lines
    said = spark.range(1).select(mrubric.prompt_of(F.lit("P"), F.lit(None).cast("string"), F.lit("L"), F.lit("M"), cats)).first()[0]
    assert "\nProblem:\nP\n" in said and '"curious": 1|2|3,\n  "overall_comments"' in said and len(mrubric.CATEGORIES) == 27
