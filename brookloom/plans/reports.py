"""Whole reports: all sections in one table, buckets crossed with factors, members of rows as documents and archives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conversation as conv
from ..operators import report
from ..sources import sinks
from ..sources.tables import table
from .catalog import ORDER, SCORES, deltas, query, sqlfmt, turns

_NULL_KEY = "NULL::BIGINT AS key, NULL::VARCHAR AS category"
_CELLS: list[str] = []
for _kind, _value in [("replies", "replies_all"), ("revisions", "revisions"), ("total", "delta_total"), *((f"delta_{c}", f"delta_{c}") for c in SCORES)]:
    _all, *_by = report.SECTIONS.get(_kind) or [n.format(_kind) for n in report.SECTIONS["category"]]
    _CELLS.append(f"SELECT '{_all}' AS section, 'ALL' AS grp, {_value} AS key, NULL::VARCHAR AS category FROM f WHERE {_value} IS NOT NULL" + (" AND scored >= 2" if _value.startswith("delta") else ""))
    _CELLS += [f"SELECT '{_s}', {_g}, {_value}, NULL FROM f WHERE {_value} IS NOT NULL" for _s, _g in zip(_by, ("service", "mentor", "school"), strict=True)]
_CELLS.append(f"SELECT '{report.SECTIONS['hours']}', 'ALL', round_even(med / 3600, 0)::BIGINT, NULL FROM f WHERE med IS NOT NULL")


def _metric(section: str, name: str, value: str, source: str) -> str:
    return f"SELECT '{report.SECTIONS[section]}' AS section, 'ALL' AS \"group\", NULL::VARCHAR AS key, NULL::BIGINT AS count, NULL::DOUBLE AS percent, '{name}' AS metric, ({value})::DOUBLE AS value, NULL::VARCHAR AS category FROM {source}"


def _correlated(section: str, x: str, where: str) -> list[str]:
    r = f"CASE WHEN count(*) >= 3 AND stddev_pop({x}) * stddev_pop(delta_total) > 0 THEN round_even(covar_pop({x}::DOUBLE, delta_total::DOUBLE) / (stddev_pop({x}) * stddev_pop(delta_total)), 4) END"
    return [_metric(section, "pearson_r", r, f"f WHERE {where}"), _metric(section, "n_pairs", "count(*)", f"f WHERE {where}")]


_REPORT = [
    "SELECT section, grp AS \"group\", key::VARCHAR AS key, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY section, grp), 2) AS percent, NULL::VARCHAR AS metric, NULL::DOUBLE AS value, category FROM cells GROUP BY section, grp, key, category",
    _metric("scored", "threads_with_2plus_scored_responses", "count(*)", "f WHERE scored >= 2"),
    _metric("summary", "mean_delta_total", "round_even(avg(delta_total), 3)", "f WHERE scored >= 2"),
    _metric("summary", "median_delta_total", "round_even(median(delta_total), 3)", "f WHERE scored >= 2"),
    *_correlated("by_replies", "replies_all", "scored >= 2"), *_correlated("by_revisions", "revisions", "scored >= 2"),
    *_correlated("by_time", "med", "med IS NOT NULL AND delta_total IS NOT NULL"),
    f"SELECT '{report.SECTIONS['share']}', 'ALL', NULL, count, CASE WHEN sum(count) OVER () = 0 THEN 0.0 ELSE round_even(100.0 * count / sum(count) OVER (), 2) END, NULL, NULL, category FROM shares",
]
_FEATURES = sqlfmt("""WITH {scored}, {deltas}, {ttr}, rep AS (SELECT l_orderkey AS thread, count(*) AS n FROM lineitem GROUP BY 1),
rev AS (SELECT conv_id AS thread, greatest(count(*) FILTER (role = 'user') - 1, 0) AS n FROM conversations GROUP BY 1),
f AS (SELECT o_orderkey AS thread, coalesce(rep.n, 0) AS replies_all, coalesce(rev.n, 0) AS revisions, coalesce(deltas.replies, 0) AS scored, delta_total, """ + ", ".join(f"delta_{c}" for c in SCORES) + """, med,
  coalesce(nullif(c_mktsegment, ''), 'NULL') AS service, CASE WHEN o_custkey IS NULL THEN 'NULL' ELSE concat_ws(' - ', o_custkey::VARCHAR, nullif(trim(c_name), '')) END AS mentor, coalesce(nullif(n_name, ''), 'NULL') AS school
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN rep ON rep.thread = o_orderkey LEFT JOIN rev ON rev.thread = o_orderkey
  LEFT JOIN deltas ON deltas.thread = o_orderkey LEFT JOIN ttr ON ttr.thread = o_orderkey),
""")


def thread_table(spark, d):
    """Features of the threads: one scan of each table; orders and lineitem meet, and are aggregated, in one partitioning."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    replies = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *ORDER)
    joined = orders.join(replies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    seconds = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 1000000
    features = report.thread_features(
        joined, "o_orderkey", reply=F.col("l_orderkey"), scored=F.col("l_returnflag") != "R", order=[F.col(c) for c in ORDER], seconds=seconds,
        scores={k: F.expr(v) for k, v in SCORES.items()}, carry=["o_custkey"])
    revised = table(spark, d, "conversations").groupBy("conv_id").agg(F.greatest(F.count_if(F.col("role") == "user") - 1, F.lit(0)).alias("student_revisions"))
    mentors = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    schools = table(spark, d, "nation").select("n_nationkey", "n_name")
    mentored = features.join(revised, F.col("o_orderkey") == F.col("conv_id"), "left").join(mentors.join(schools, F.col("c_nationkey") == F.col("n_nationkey"), "left"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return mentored.select(
        F.col("o_orderkey").alias("thread"), "mentor_reply_count", F.coalesce("student_revisions", F.lit(0)).alias("student_revisions"), "scored_replies", "reply_seconds_median", "delta_total",
        *(f"delta_{c}" for c in SCORES), F.col("c_mktsegment").alias("service_name"), report.label(F.col("o_custkey"), F.col("c_name")).alias("mentor_label"), F.col("n_name").alias("school_name"))


@query(_FEATURES + "cells AS (" + " UNION ALL ".join(_CELLS) + "), shares AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) FILTER (delta_{c} > 0) AS count FROM f" for c in SCORES) + ") " + " UNION ALL ".join(_REPORT))
def q_base_report(spark, d):
    """Every section as rows of one sparse table, in order."""
    return report.whole_report(thread_table(spark, d), ordered=True)


@query(sqlfmt("""WITH {scored}, {deltas}, r AS (SELECT conv_id AS thread, greatest(count(*) FILTER (role = 'user') - 1, 0) AS revisions FROM conversations GROUP BY 1)
SELECT round_even(CASE WHEN count(*) >= 3 AND stddev_pop(revisions) * stddev_pop(delta_total) > 0 THEN covar_pop(revisions::DOUBLE, delta_total::DOUBLE) / (stddev_pop(revisions) * stddev_pop(delta_total)) END, 4) AS pearson_r, count(*) AS n_pairs FROM r JOIN deltas USING (thread) WHERE replies >= 2"""))
def q_pearson_revisions_delta(spark, d):
    revised = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("thread")).agg(F.greatest(F.count_if(F.col("role") == "user") - 1, F.lit(0)).alias("revisions"))
    return report.correlation(revised.join(deltas(spark, d).where("replies >= 2"), "thread"), "revisions", "delta_total")


# ---- three buckets, four factors, all threads and mentored ones

_ROWS = """rows AS (SELECT n_chars % 4 AS replies, n_chars % 3 AS revisions, n_chars % 5 - 2 AS delta, lang AS service, source AS school, coalesce((doc_id % 7)::VARCHAR, 'NULL') AS mentor,
CASE WHEN n_chars % 6 = 0 THEN 'NULL' ELSE (n_chars % 6)::VARCHAR END AS reply_time_bin, quality, toxic FROM documents JOIN labels USING (doc_id)),
subsets AS (SELECT 'all' AS subset, * FROM rows UNION ALL SELECT 'mentored_only', * FROM rows WHERE replies >= 1),
buckets AS (UNPIVOT (SELECT subset, replies::VARCHAR AS replies, revisions::VARCHAR AS revisions, delta::VARCHAR AS delta, service, school, mentor, reply_time_bin, quality, toxic FROM subsets) ON replies, revisions, delta INTO NAME bucket VALUE bucket_value),
kept AS (SELECT * FROM buckets WHERE NOT (subset = 'mentored_only' AND bucket = 'replies'))"""
FACTORS = ["service", "school", "mentor", "reply_time_bin"]


def bucketed(spark, d):
    """Labelled rows by subset and bucket; the mentored subset leaves out the bucket that defines it."""
    docs = table(spark, d, "documents")
    n = F.col("n_chars")
    bin_ = F.when(n % 6 == 0, "NULL").otherwise((n % 6).cast("string"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").select((n % 4).alias("replies"), (n % 3).alias("revisions"), (n % 5 - 2).alias("delta"), F.col("lang").alias("service"), F.col("source").alias("school"), F.coalesce((F.col("doc_id") % 7).cast("string"), F.lit("NULL")).alias("mentor"), bin_.alias("reply_time_bin"), "quality", "toxic")
    subsets = F.explode(F.when(F.col("replies") >= 1, F.array(F.lit("all"), F.lit("mentored_only"))).otherwise(F.array(F.lit("all")))).alias("subset")
    buckets = F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).cast("string").alias("bucket_value")) for b in ("replies", "revisions", "delta")))).alias("b")
    return rows.select("*", subsets).select("*", buckets).select("*", "b.*").where("bucket_value IS NOT NULL AND NOT (subset = 'mentored_only' AND bucket = 'replies')")


def _levels():
    return F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).cast("bigint").alias("score_level")) for c in ("quality", "toxic")))).alias("l")


@query(f"""WITH {_ROWS}, x AS (UNPIVOT kept ON quality, toxic INTO NAME category VALUE score_level)
SELECT subset, bucket, bucket_value, category, score_level::BIGINT AS score_level, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY subset, bucket, bucket_value, category), 2) AS percent FROM x GROUP BY subset, bucket, bucket_value, category, score_level""")
def q_dist_all_buckets(spark, d):
    long = bucketed(spark, d).select("subset", "bucket", "bucket_value", _levels()).select("subset", "bucket", "bucket_value", "l.*").where("score_level IS NOT NULL")
    return report.breakdown(long, ["subset", "bucket", "bucket_value", "category"], "score_level")


@query(f"""WITH {_ROWS}, f AS (UNPIVOT kept ON service, school, mentor, reply_time_bin INTO NAME factor VALUE factor_value), x AS (UNPIVOT f ON quality, toxic INTO NAME category VALUE score_level)
SELECT subset, bucket, bucket_value, factor, factor_value, category, score_level::BIGINT AS score_level, count(*) AS count,
round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY subset, bucket, bucket_value, factor, factor_value, category), 2) AS percent FROM x GROUP BY subset, bucket, bucket_value, factor, factor_value, category, score_level""")
def q_crossed_all(spark, d):
    """Three buckets by four factors in one aggregation."""
    factors = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f), F.lit("NULL")).alias("factor_value")) for f in FACTORS))).alias("f")
    groups = ["subset", "bucket", "bucket_value", "factor", "factor_value"]
    long = bucketed(spark, d).select("*", factors).select(*groups[:3], "f.*", _levels()).select(*groups, "l.*").where("score_level IS NOT NULL")
    return report.breakdown(long, [*groups, "category"], "score_level")


# ---- members of report rows

_MEMBERS = """m AS (SELECT 'B' AS section, 'revisions' AS grp, greatest(count(*) FILTER (role = 'user') - 1, 0) AS key, conv_id AS thread FROM conversations GROUP BY conv_id)"""


def _members(spark, d):
    counted = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("thread")).agg(F.greatest(F.count_if(F.col("role") == "user") - 1, F.lit(0)).alias("key"))
    return counted.select(F.lit("B").alias("section"), F.lit("revisions").alias("grp"), "key", "thread")


@query(f"WITH {_MEMBERS}, t AS (SELECT conv_id AS thread, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1) SELECT section || '_' || grp || '_key_' || key || '.zip' AS archive, 'thread_' || thread || '.txt' AS path, content FROM m JOIN t USING (thread)")
def q_row_documents(spark, d):
    """The documents of the threads behind each row of a report, by the archive they go to."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    texts = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("thread")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("content"))
    found = _members(spark, d).join(texts, "thread")
    return found.select(report.archive_name(F.col("section"), F.col("grp"), F.col("key")).alias("archive"), F.concat(F.lit("thread_"), F.col("thread").cast("string"), F.lit(".txt")).alias("path"), "content")


@query(f"WITH {_MEMBERS} SELECT DISTINCT thread FROM m UNION SELECT l_orderkey FROM lineitem")
def q_needed_threads(spark, d):
    """The threads that any of two reports refers to."""
    return _members(spark, d).select("thread").union(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("thread"))).distinct()


@query("SELECT o_orderkey AS thread, CASE WHEN o_orderkey % 3 = 0 THEN 'thread_' || o_orderkey || '.txt' END AS have, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'thread_' || o_orderkey || '.txt' END, 'made_' || o_orderkey) AS path FROM orders")
def q_ensured_files(spark, d):
    """Needed threads with the file that is there, else the one to be made."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("thread"))
    have = orders.where("thread % 3 = 0").select("thread", F.concat(F.lit("thread_"), F.col("thread").cast("string"), F.lit(".txt")).alias("have"))
    return orders.join(have, "thread", "left").withColumn("path", F.coalesce("have", F.concat(F.lit("made_"), F.col("thread").cast("string"))))


# ---- threads as files

_USERS = """m AS (SELECT conv_id, turn, text, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt, lead(turn) OVER w AS nturn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, coalesce(text, '') AS q, CASE WHEN nr = 'assistant' THEN coalesce(nt, '') ELSE '' END AS a, CASE WHEN nr = 'assistant' THEN nturn END AS aturn FROM m WHERE role = 'user')"""


@query(f"""WITH {_USERS} SELECT conv_id, 'Problem statement: problem ' || conv_id || chr(10) || chr(10) || 'Age: ' || (conv_id % 9 + 6) || chr(10) || 'School: school ' || (conv_id % 5) || chr(10) || chr(10) || 'Mentor Name: mentor ' || (conv_id % 3) || chr(10) || chr(10) ||
string_agg('Student Submission (submitted on ' || turn || ') Short Answer ' || n || ': ' || q || chr(10) || chr(10) || 'Student Submission (submitted on ' || turn || ') Long Answer ' || n || ': ' || 'I think ' || q || chr(10) || chr(10) ||
CASE WHEN a = '' THEN 'Mentor Response: (No reply yet)' ELSE 'Mentor Response (responded on ' || aturn || ') ' || n || ': ' || a END || chr(10) || chr(10) || 'Rubric ' || n || ': Strategy: ' || (length(q) % 5) || '; Clarity: ' || (length(q) % 7) || chr(10), chr(10) ORDER BY n) AS content FROM u GROUP BY conv_id""")
def q_thread_export(spark, d):
    """Threads as text files: header, both answers, replies with dates, images and scores of each message."""
    rows = nested_messages(spark, d)
    head = {"problem": F.concat(F.lit("problem "), F.col("conv_id").cast("string")), "age": (F.col("conv_id") % 9 + 6).cast("string"), "school": F.concat(F.lit("school "), (F.col("conv_id") % 5).cast("string")), "mentor": F.concat(F.lit("mentor "), (F.col("conv_id") % 3).cast("string")), "student": F.lit("")}
    return rows.select("conv_id", conv.exported(F.col("conversation"), **head, scores=["strategy", "clarity"]).alias("content"))


def nested_messages(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("q"), F.lead("role").over(w).alias("nr"), F.lead("text").over(w).alias("nt"), F.lead("turn").over(w).alias("nturn")).where("role = 'user'")
    answered = F.col("nr") == "assistant"
    n = F.length("q").cast("bigint")
    images = F.array().cast("array<struct<field:string,index:int,base64:string>>")
    rows = rows.select("conv_id", "turn", F.col("turn").cast("string").alias("submission_date"), F.col("q").alias("short_answer"), F.concat(F.lit("I think "), "q").alias("long_answer"), F.coalesce(F.when(answered, F.col("nt")), F.lit("")).alias("response"), F.when(answered, F.col("nturn").cast("string")).alias("response_date"), F.struct((n % 5).alias("strategy"), (n % 7).alias("clarity")).alias("rubrics"), images.alias("images"))
    return conv.nested(rows, "conv_id", "turn", ["submission_date", "short_answer", "long_answer", "response", "response_date", "rubrics", "images"])


@query(f"""WITH {_USERS} SELECT 'thread_' || conv_id || '.json' AS path, to_json({{'conv_id': conv_id, 'conversation': list({{'submission_date': turn::VARCHAR, 'short_answer': q, 'long_answer': 'I think ' || q, 'response': a, 'response_date': aturn::VARCHAR,
'rubrics': {{'strategy': length(q) % 5, 'clarity': length(q) % 7}}, 'images': []::STRUCT(field VARCHAR, index INTEGER, base64 VARCHAR)[]}} ORDER BY n)}})::VARCHAR AS content FROM u GROUP BY conv_id""")
def q_thread_json(spark, d):
    """Threads as JSON files; missing values are kept as null."""
    return sinks.thread_json(nested_messages(spark, d), ["conv_id", "conversation"])


@query(sqlfmt("""WITH {users}, t AS (SELECT conv_id, bool_or(length(text) >= 40) AS keep, max(idx) + 1 AS messages FROM users GROUP BY 1)
SELECT CASE WHEN keep THEN 'main' ELSE 'dropped' END AS archive, 'thread_' || conv_id || '.txt' AS path, messages FROM t"""))
def q_filtered_members(spark, d):
    """Which archive each thread's text goes to, JSON and text members meeting by name."""
    users = conv.numbered(turns(spark, d, "user").select("conv_id", "turn", "text"), "conv_id", [F.col("turn")])
    kept = users.groupBy("conv_id").agg(F.bool_or(F.length("text") >= 40).alias("keep"), (F.max("idx") + 1).cast("bigint").alias("messages"))
    json_members = kept.select(F.concat(F.lit("thread_"), F.col("conv_id").cast("string"), F.lit(".json")).alias("json"), "keep", "messages")
    text_members = users.select(F.concat(F.lit("thread_"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path")).distinct()
    joined = json_members.join(text_members, F.replace("json", F.lit(".json"), F.lit(".txt")) == F.col("path"))
    return joined.select(F.when(F.col("keep"), "main").otherwise("dropped").alias("archive"), "path", "messages")

