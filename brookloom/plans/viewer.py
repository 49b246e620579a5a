"""The joins and filters behind the viewers: details of a submission, thread lists, lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import report, threads
from ..sources.tables import table
from .catalog import query


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderdate, c_name, cn.n_name AS school, cr.r_name AS region, p_name, s_name, sn.n_name AS teacher_school, sr.r_name AS teacher_region
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey""")
def q_detail_join(spark, d):
    """Each submission with everything that is known of it: nine tables joined from the left."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    pupils = places.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("school"), F.col("r_name").alias("region"))
    teachers = places.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("teacher_school"), F.col("r_name").alias("teacher_region"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = rows.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    out = out.join(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").join(pupils, F.col("c_nationkey") == F.col("cn"), "left")
    out = out.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    out = out.join(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(teachers, F.col("s_nationkey") == F.col("sn"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "o_orderdate", "c_name", "school", "region", "p_name", "s_name", "teacher_school", "teacher_region")


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_viewer_threads(spark, d):
    """Threads with their publication and puzzle, which they must have, and the mentor, if there is one."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    joined = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "r_name")


_LIST = """list AS (SELECT c.conv_id, count(*) FILTER (role = 'user') AS subs, count(*) FILTER (role = 'assistant') AS replies, bool_or(text LIKE '%base64,%') AS images, bool_or(lower(text) LIKE '%he%') AS named, bool_or(e.thread IS NOT NULL) AS feedback
FROM conversations c LEFT JOIN (SELECT DISTINCT user_id AS thread FROM events) e ON c.conv_id = e.thread GROUP BY 1)"""


@query(f"WITH {_LIST} SELECT conv_id, subs, replies, feedback FROM list WHERE named AND subs >= 1 AND replies >= 1 AND NOT images AND conv_id::VARCHAR LIKE '%1%'")
def q_viewer_filters(spark, d):
    """Threads by part of an id, part of a text, least counts, images and feedback."""
    rows = table(spark, d, "conversations")
    of = lambda r: F.count_if(F.col("role") == r)
    found = rows.groupBy("conv_id").agg(of("user").alias("subs"), of("assistant").alias("replies"), F.bool_or(F.contains("text", F.lit("base64,"))).alias("images"), F.bool_or(F.contains(F.lower("text"), F.lit("he"))).alias("named"))
    feedback = table(spark, d, "events").select(F.col("user_id").alias("conv_id")).distinct().withColumn("feedback", F.lit(True))
    wanted = F.col("named") & (F.col("subs") >= 1) & (F.col("replies") >= 1) & ~F.col("images") & F.contains(F.col("conv_id").cast("string"), F.lit("1"))
    return found.where(wanted).join(feedback, "conv_id", "left").select("conv_id", "subs", "replies", F.coalesce("feedback", F.lit(False)).alias("feedback"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2, 4) AND coalesce(s_acctbal, 0) >= 0")
def q_teachers_by_role(spark, d):
    """Members of some roles that aren't deleted."""
    nations = table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 2, 4))
    return table(spark, d, "supplier").where(F.coalesce("s_acctbal", F.lit(0.0)) >= 0).join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT l_orderkey AS thread, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey % 7 = o_custkey % 7 GROUP BY 1")
def q_own_submissions(spark, d):
    """Submissions by the creator of their thread: a join on two keys, counted."""
    subs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("thread"), (F.col("l_suppkey") % 7).alias("creator"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("thread"), (F.col("o_custkey") % 7).alias("creator"))
    return subs.join(own, ["thread", "creator"]).groupBy("thread").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, p_name, s_name, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def q_three_way(spark, d):
    """Replies with submission and scores, all of which must be there."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = rows.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select("l_orderkey", "l_linenumber", "p_name", "s_name", "l_quantity")


@query("""WITH f AS (SELECT o_orderkey, o_custkey, count(l_orderkey) AS replies FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, replies, coalesce(p_name, '') AS puzzle, coalesce(o_custkey || ' - ' || c_name, 'NULL') AS mentor FROM lineitem LEFT JOIN f ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey""")
def q_reply_features(spark, d):
    """Replies with features of their thread, the puzzle's text and the mentor's label."""
    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("replies"))
    features = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(counted, "o_orderkey", "left").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    out = rows.join(features, "o_orderkey", "left").join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "left")
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.coalesce("replies", F.lit(0)).alias("replies"), F.coalesce("p_name", F.lit("")).alias("puzzle"), report.label(F.col("o_custkey"), F.col("c_name")).alias("mentor"))


@query("""SELECT o_orderkey, arg_max(c_name, (n_regionkey, n_nationkey)) AS pupil, arg_max(n_name, (n_regionkey, n_nationkey)) AS school FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey % 10 = c_custkey % 10 LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def q_last_membership_wins(spark, d):
    """Submissions with pupil, memberships and groups; of several groups the last one, in one order."""
    nations = table(spark, d, "nation")
    groups = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("m"), "s_nationkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    # the last group of each member first, so that memberships don't multiply submissions
    last = groups.groupBy("m").agg(F.max_by("n_name", F.struct("n_regionkey", "n_nationkey")).alias("school"))
    pupils = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("pupil"), (F.col("c_custkey") % 10).alias("m")).join(last, "m", "left")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(pupils, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "pupil", "school")


@query("SELECT o_custkey AS thread, arg_min(nullif(o_orderkey % 5, 0), o_orderkey) FILTER (nullif(o_orderkey % 5, 0) IS NOT NULL) AS creator FROM orders GROUP BY 1")
def q_first_creator(spark, d):
    """The first creator of a thread's submissions that isn't null or 0."""
    creator = F.nullif(F.col("o_orderkey") % 5, F.lit(0))
    known = F.when(creator.isNotNull(), F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("thread")).agg(F.min_by(creator, known).alias("creator"))


@query("SELECT c_custkey, CASE WHEN trim(coalesce(nullif(c_name, ''), '') || ' ' || coalesce(nullif(c_mktsegment, ''), '')) <> '' THEN trim(coalesce(nullif(c_name, ''), '') || ' ' || coalesce(nullif(c_mktsegment, ''), '')) ELSE 'user_' || c_custkey END AS name, c_name || ' ' || c_mktsegment AS joined, CASE WHEN length(c_name) > 10 THEN c_name[:10] || '...' ELSE c_name END AS short, coalesce(c_nationkey::VARCHAR, '') AS age FROM customer")
def q_names(spark, d):
    """Names for display, with and without parts; cut; an age as text."""
    rows = table(spark, d, "customer")
    name = report.display_name(F.nullif(F.col("c_name"), F.lit("")), F.nullif(F.col("c_mktsegment"), F.lit("")), F.lit(None).cast("string"), F.col("c_custkey"))
    return rows.select("c_custkey", name.alias("name"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("joined"), X.shown(F.col("c_name"), 10).alias("short"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("")).alias("age"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0) + coalesce(l_linenumber, 0) + coalesce(l_tax, 0) AS total, CASE WHEN l_returnflag = 'R' THEN 'N' ELSE 'Y' END AS filled FROM lineitem WHERE coalesce(l_quantity, 0) + coalesce(l_linenumber, 0) + coalesce(l_tax, 0) >= 10")
def q_total_scores(spark, d):
    """Submissions of a least total score, and whether they are filled."""
    total = F.coalesce("l_quantity", F.lit(0.0)) + F.coalesce("l_linenumber", F.lit(0)) + F.coalesce("l_tax", F.lit(0.0))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", total.alias("total"), F.when(F.col("l_returnflag") == "R", "N").otherwise("Y").alias("filled"))
    return rows.where("total >= 10")


@query("SELECT user_id AS thread, count(*) AS entries, max(event_id) AS last FROM events WHERE json_valid(props) GROUP BY 1")
def q_feedback_log(spark, d):
    """A feedback log: entries by thread, those that aren't JSON left out."""
    parsed = table(spark, d, "events").where(F.try_parse_json("props").isNotNull())
    return parsed.groupBy(F.col("user_id").alias("thread")).agg(F.count("*").alias("entries"), F.max("event_id").alias("last"))


@query("SELECT l_orderkey, l_linenumber, (epoch_ms(l_shipdate) // 1000 - epoch_ms(o_orderdate) // 1000)::DOUBLE AS seconds, '(submitted on ' || strftime(o_orderdate, '%Y-%m-%d') || ')' AS submitted FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_whole_seconds(spark, d):
    """Reply times in whole seconds, negative ones too, and dates as text."""
    ms = lambda c: F.floor(F.unix_millis(F.col(c).cast("timestamp")) / 1000)
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", (ms("l_shipdate") - ms("o_orderdate")).cast("double").alias("seconds"), F.concat(F.lit("(submitted on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(")")).alias("submitted"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS publications, count(DISTINCT c_nationkey) AS schools FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q_distinct_publications(spark, d):
    """Publications taken once each, then counted with their schools."""
    once = table(spark, d, "orders").select("o_orderstatus", "o_custkey").distinct()
    joined = once.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("publications"), F.count_distinct("c_nationkey").alias("schools"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 AS endpoint FROM orders")
def q_round_robin(spark, d):
    """Work dealt to three endpoints in turn; rows are numbered inside ranges of ids, whose sizes are summed before."""
    orders = table(spark, d, "orders").select("o_orderkey")
    ranged = orders.withColumn("_range", F.floor(F.col("o_orderkey") / 10_000))
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy("o_orderkey")) - 1
    placed = ranged.withColumn("_own", own).join(before, "_range")
    return placed.select("o_orderkey", ((F.coalesce("_before", F.lit(0)) + F.col("_own")) % 3).cast("bigint").alias("endpoint"))


# ---- the viewers' own operators over submissions of the conversations

_SUBS = """m AS (SELECT conv_id, turn, text, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
subs AS (SELECT conv_id AS thread_id, turn, coalesce(text, '') AS short_answer, coalesce('I think ' || text, '') AS long_answer, CASE WHEN nr = 'assistant' THEN coalesce(nt, '') ELSE '' END AS response,
  CASE WHEN length(text) % 3 <> 0 THEN length(text) % 5 END AS strategy, CASE WHEN length(text) % 4 <> 0 THEN length(text) % 7 END AS clarity FROM m WHERE role = 'user'),
metrics AS (SELECT thread_id, 'Problem ' || thread_id AS puzzle_text, 'mentor ' || thread_id % 3 AS mentor_name, count(*) AS num_subs, count(*) FILTER (strategy IS NOT NULL OR clarity IS NOT NULL) AS num_rubrics,
  count(*) FILTER (trim(response, E' \\n\\t\\r') <> '') AS num_mentor_msgs, median(length(short_answer))::DOUBLE AS median_short, median(length(long_answer))::DOUBLE AS median_long, median(length(response))::DOUBLE AS median_mentor,
  bool_or(regexp_matches(short_answer || ' ' || long_answer || ' ' || response, 'data:image/[^;]+;base64,', 'i')) AS has_images, 'School ' || thread_id % 5 AS school_name FROM subs GROUP BY thread_id)"""


def submissions(spark, d):
    """Each user turn of a conversation with the reply after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("nr"), F.lead("text").over(w).alias("nt")).where("role = 'user'")
    n = F.length("text")
    return rows.select(
        F.col("conv_id").alias("thread_id"), "turn", F.col("text").alias("short_answer"), F.concat(F.lit("I think "), "text").alias("long_answer"), F.when(F.col("nr") == "assistant", F.col("nt")).alias("response"),
        F.when(n % 3 != 0, n % 5).alias("strategy"), F.when(n % 4 != 0, n % 7).alias("clarity"), F.concat(F.lit("School "), (F.col("conv_id") % 5).cast("string")).alias("school_name"),
        F.concat(F.lit("Problem "), F.col("conv_id").cast("string")).alias("puzzle_text"), F.concat(F.lit("mentor "), (F.col("conv_id") % 3).cast("string")).alias("mentor_name"))


def _metrics(spark, d):
    return threads.thread_metrics(submissions(spark, d), "thread_id", "turn", ["strategy", "clarity"], carry=["puzzle_text", "mentor_name"])


@query(f"WITH {_SUBS} SELECT * FROM metrics")
def q_all_thread_metrics(spark, d):
    """All that the list of threads shows and searches."""
    return _metrics(spark, d)


@query(f"""WITH {_SUBS} SELECT * FROM metrics WHERE thread_id::VARCHAR LIKE '%1%' AND lower(puzzle_text) LIKE '%problem%' AND lower(school_name) LIKE '%school%' AND lower(mentor_name) LIKE '%mentor%'
AND num_subs >= 1 AND num_mentor_msgs >= 1 AND num_rubrics >= 1 AND median_short >= 20 AND median_long >= 25 AND median_mentor >= 10 AND NOT has_images AND thread_id IN (SELECT user_id FROM events)""")
def q_thread_search(spark, d):
    """Threads by a whole search form: four texts, six thresholds, images and feedback."""
    asked = {"thread_id": "1", "puzzle_text": "PROBLEM", "school_name": "school", "mentor_name": " Mentor ", "num_subs": "1", "num_mentor_msgs": "1", "num_rubrics": "1", "median_short": "20", "median_long": "25", "median_mentor": "10", "has_images": "no", "has_feedback": "Yes"}
    return threads.searched(_metrics(spark, d), asked, table(spark, d, "events").select(F.col("user_id").alias("thread_id")))


@query(f"""WITH {_SUBS}, s AS (SELECT thread_id, turn, (coalesce(strategy, 0) + coalesce(clarity, 0))::DOUBLE AS total_score, CASE WHEN short_answer <> '' AND long_answer <> '' AND response <> '' THEN 'Y' ELSE 'N' END AS filled, short_answer FROM subs)
SELECT thread_id, turn, total_score, filled FROM s WHERE turn::VARCHAR LIKE '%1%' AND lower('Problem ' || thread_id) LIKE '%problem%' AND lower(short_answer) LIKE '%e%' AND total_score >= 3.5 AND filled = 'Y'""")
def q_submission_search(spark, d):
    """Submissions by a whole form: id, puzzle, answer, images, least total score, filled."""
    rows = submissions(spark, d).withColumns({"submission_id": F.col("turn"), "images": F.array().cast("array<string>")})
    asked = {"id": "1", "puzzle": "PROBLEM", "short_answer": "E", "images": "n", "min_score": "3.5", "filled": "y"}
    return threads.submissions_like(rows, asked, ["strategy", "clarity"]).select("thread_id", "turn", "total_score", "filled")
