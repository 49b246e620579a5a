"""Replies scored on many categories: prompts, scored rows with the features of their threads, and all distributions in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import bin_half_even, percent
from ..sources.sinks import write_csv
from .client import Client
from .scoring import stored_scores

#: The categories of a score, its other columns, and the reports.
CATEGORIES = [
    "build_on_student_thinking", "specificity_actionability", "mathematical_soundness", "questioning_scaffolding", "clarity_conciseness", "affect_support", "concise", "curious", "focused_questions",
    "accessible", "concrete", "collaborative", "specific", "encouraging", "nice_tone", "improve_work", "empowerment_confidence", "developing_thinking", "identity_competence", "efficiency",
    "encouraging_engagement", "process_oriented", "modeling_progression", "promote_curiosity", "individualized", "clear_actionable", "guiding_questions"]
COMMENTS = "overall_comments"
ROW = ["response_id", "thread_id", "mentor_user_id", "mentor_name", "mentor_label", "response_date", "mentor_reply_count", "student_revisions", "delta_total", "service_name", "school_name", "teacher_user_id", "reply_seconds_median"]
BUCKETS = ["mentor_reply_count", "student_revisions", "delta_total"]
FACTORS = ["service_name", "school_name", "mentor_label", "reply_time_bin"]
GROUPS = ["mentor_label", "school_name"]


def prompt_of(puzzle: Column, short: Column, long: Column, message: Column, categories: list[str] = CATEGORIES) -> Column:
    """What a judge is asked about a reply: the problem, both answers, the message, and the keys of the answer."""
    keys = ",\n  ".join([*(f'"{c}": 1|2|3' for c in categories), f'"{COMMENTS}": "very brief reasoned summary (<=30 words)"'])
    parts = [("Problem", puzzle), ("Student submission (short answer)", short), ("Student submission (long answer)", long), ("Mentor message", message)]
    said = [F.lit("Score a mentoring reply with integers 1-3 (1=weak, 2=adequate, 3=strong). Return one strict JSON object and nothing else.\n")]
    for name, c in parts:
        said += [F.lit(f"\n{name}:\n"), F.coalesce(c, F.lit("")), F.lit("\n")]
    return F.concat(*said, F.lit(f"\nReturn JSON with keys:\n{{\n  {keys}\n}}\n"))


def schema(categories: list[str] = CATEGORIES) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.LongType()) for c in categories), T.StructField(COMMENTS, T.StringType())])


def scored_rows(replies: DataFrame, features: DataFrame, client: Client | list[Client], store: str, categories: list[str] = CATEGORIES, **options) -> DataFrame:
    """ROW, the categories and the comments of each reply that a client scores; answers are committed by batch to the store.

    replies: response_id, thread_id, response_date and prompt; features: the rest of ROW by thread.  A reply
    whose thread has no features keeps nulls; replies that stay without an answer are left out.
    """
    scores = stored_scores(replies, "response_id", "prompt", client, schema(categories), store, **options)
    rows = replies.select("response_id", "thread_id", "response_date").dropDuplicates(["response_id"]).join(scores, "response_id").join(features, "thread_id", "left")
    have = set(rows.columns)
    return rows.select(*(c if c in have else F.lit(None).cast("string").alias(c) for c in ROW), *categories, COMMENTS)


def distributions(rows: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """All reports as one table: report, subset, bucket_value, factor, factor_value, category, score_level, count, percent.

    report is by_<group>, by_<bucket> or <bucket>_x_<factor>.  Buckets other than the replies only count threads
    with a reply; a missing bucket and a blank factor are 'NULL'; missing scores aren't counted; percents are within all but the level.
    A row is exploded into its cells and its scores, and summed before the shuffle.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit("NULL"))
    blank = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", "NULL").otherwise(F.col(c).cast("string"))
    hours = text(bin_half_even(F.col("reply_seconds_median") / 3600))
    factor = {f: hours if f == "reply_time_bin" else blank(f) for f in FACTORS}
    bucket = {b: text(bin_half_even(F.col(b).cast("double")) if b == "delta_total" else F.col(b)) for b in BUCKETS}
    counts = {b: F.lit(True) if b == "mentor_reply_count" else F.coalesce(F.col("mentor_reply_count") >= 1, F.lit(False)) for b in BUCKETS}
    none = F.lit(None).cast("string")

    def cell(report: str, subset: Column, value: Column, name: Column, of: Column) -> Column:
        return F.struct(F.lit(report).alias("report"), subset.alias("subset"), value.alias("bucket_value"), name.alias("factor"), of.alias("factor_value"))

    cells = [cell(f"by_{g}", none, none, F.lit(g), factor[g]) for g in GROUPS]
    for b in BUCKETS:
        cells.append(F.when(counts[b], cell(f"by_{b}", F.lit(b), bucket[b], none, none)))
        cells += [F.when(counts[b], cell(f"{b}_x_{f}", F.lit(b), bucket[b], F.lit(f), factor[f])) for f in FACTORS]
    levels = F.filter(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).cast("bigint").alias("score_level")) for c in categories)), lambda s: s["score_level"].isNotNull())
    long = rows.select(levels.alias("levels"), F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL").select("cell.*", F.explode("levels").alias("l")).select("report", "subset", "bucket_value", "factor", "factor_value", "l.*")
    own = ["report", "subset", "bucket_value", "factor", "factor_value", "category"]
    counted = long.groupBy(*own, "score_level").agg(F.count("*").alias("count"))
    return counted.withColumn("percent", percent(F.col("count"), F.sum("count").over(Window.partitionBy(*own))))


def write_reports(rows: DataFrame, folder: str, categories: list[str] = CATEGORIES) -> None:
    """Scores and every report as a folder of CSV; the distributions are computed once, to a table beside them."""
    spark = rows.sparkSession
    write_csv(rows, f"{folder}/scores", [*ROW, *categories, COMMENTS])
    distributions(rows, categories).write.mode("overwrite").parquet(f"{folder}/distributions")
    table = spark.read.parquet(f"{folder}/distributions")
    level = ["category", "score_level", "count", "percent"]
    for g in GROUPS:
        own = table.where(F.col("report") == f"by_{g}").select(F.col("factor").alias("group_key"), F.col("factor_value").alias("group_value"), *level)
        write_csv(own.coalesce(1), f"{folder}/by_{g}", ["group_key", "group_value", *level])
    for b in BUCKETS:
        write_csv(table.where(F.col("report") == f"by_{b}").coalesce(1), f"{folder}/by_{b}", ["subset", "bucket_value", *level])
        write_csv(table.where(F.col("report").startswith(f"{b}_x_")).coalesce(1), f"{folder}/{b}_crossed", ["subset", "bucket_value", "factor", "factor_value", *level])
