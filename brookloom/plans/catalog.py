"""All queries of the engine by name, and the SQL that gives the same rows.

The driver's tables stand for the mentoring corpus: orders are threads, lineitem rows are replies with
scores, customers mentors, market segments services, nations schools; conversations are threads of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks, vectors
from ..functions import text as X
from ..functions.numeric import bin_half_even, percent
from ..operators import conversation as conv
from ..operators import filters, nearest, report, scoring
from ..sources.tables import table
from ..streaming.ingest import new_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sqlfmt(text: str) -> str:
    """Shared parts of the SQL put in."""
    return text.replace("{scored}", SCORED).replace("{deltas}", DELTAS).replace("{ttr}", TTR).replace("{users}", USERS)


# ---- shared parts, as DataFrames and as SQL

SCORES = {
    "strategy": "cast(l_quantity as int) % 5",
    "interpretation": "l_linenumber % 5",
    "accuracy": "cast(round(l_discount * 100) as int) % 5",
    "completeness": "cast(round(l_tax * 100) as int) % 5",
    "clarity": "cast(l_quantity as int) % 3",
    "reflection": "cast(l_quantity as int) % 4",
}
ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SCORED = f"""scored AS (SELECT l_orderkey AS thread, {", ".join(f"{v} AS {k}" for k, v in SCORES.items())},
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS up,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(f"{o} DESC" for o in ORDER)}) AS down
  FROM lineitem WHERE l_returnflag <> 'R')"""
DELTAS = f"""deltas AS (SELECT a.thread, n.replies, {", ".join(f"(b.{k} - a.{k})::BIGINT AS delta_{k}" for k in SCORES)},
  ({" + ".join(f"b.{k} - a.{k}" for k in SCORES)})::BIGINT AS delta_total
  FROM (SELECT * FROM scored WHERE up = 1) a JOIN (SELECT * FROM scored WHERE down = 1) b USING (thread)
  JOIN (SELECT thread, count(*) AS replies FROM scored GROUP BY thread) n USING (thread))"""
TTR = """ttr AS (SELECT o_orderkey AS thread, median(epoch(l_shipdate) - epoch(o_orderdate)) AS med, avg(epoch(l_shipdate) - epoch(o_orderdate)) AS mean
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""
USERS = """users AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE role = 'user')"""


def scored_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    return rows.select(F.col("l_orderkey").alias("thread"), *(F.expr(v).alias(k) for k, v in SCORES.items()), *ORDER)


def deltas(spark: SparkSession, d: str) -> DataFrame:
    return report.first_last_deltas(scored_replies(spark, d), "thread", ORDER)


def threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads with service, mentor and school."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("thread"), "o_custkey", "o_orderdate")
    mentors = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    schools = table(spark, d, "nation").select("n_nationkey", "n_name")
    return orders.join(mentors, F.col("o_custkey") == F.col("c_custkey"), "left").join(schools, F.col("c_nationkey") == F.col("n_nationkey"), "left")


def reply_times(spark: SparkSession, d: str) -> DataFrame:
    """Median and mean seconds to the replies of each thread; negative ones stay."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("thread"), "o_orderdate")
    replies = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("thread"), "l_shipdate")
    seconds = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 1000000
    return report.reply_seconds(replies.join(orders, "thread").select("thread", seconds.alias("seconds")), "thread", "seconds")


def turns(spark: SparkSession, d: str, role: str) -> DataFrame:
    return table(spark, d, "conversations").where(F.col("role") == role)


def nested_threads(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the assistant turn after it, nested by conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    rows = rows.where("role = 'user'").select("conv_id", F.col("turn"), F.col("text").alias("short_answer"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"), F.struct((F.length("text") % 5).alias("strategy"), (F.length("text") % 7).alias("clarity")).alias("rubrics"))
    return conv.nested(rows, "conv_id", "turn", ["short_answer", "response", "rubrics"])


# ---- distributions


@query("""WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT 'A' AS section, 'replies' AS "group", n AS key, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM c GROUP BY n""")
def q_reply_distribution(spark, d):
    counted = report.zero_filled_counts(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "n")
    return report.distribution(counted, F.col("n"), "A", "replies")


@query("""WITH c AS (SELECT conv_id, greatest(count(*) FILTER (role = 'user') - 1, 0) AS n FROM conversations GROUP BY 1)
SELECT 'B' AS section, 'revisions' AS "group", n AS key, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM c GROUP BY n""")
def q_revision_distribution(spark, d):
    counted = table(spark, d, "conversations").groupBy("conv_id").agg(F.greatest(F.count_if(F.col("role") == "user") - 1, F.lit(0)).alias("n"))
    return report.distribution(counted, F.col("n"), "B", "revisions")


@query(sqlfmt("""WITH {scored}, {deltas}
SELECT 'C' AS section, 'total' AS "group", delta_total AS key, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent
FROM deltas WHERE replies >= 2 GROUP BY delta_total"""))
def q_score_delta_distribution(spark, d):
    return report.distribution(deltas(spark, d).where("replies >= 2"), bin_half_even(F.col("delta_total")), "C", "total")


@query(sqlfmt("""WITH {scored}, {deltas}, x AS (UNPIVOT (SELECT thread, delta_strategy, delta_interpretation, delta_accuracy, delta_completeness, delta_clarity, delta_reflection FROM deltas WHERE replies >= 2)
ON delta_strategy, delta_interpretation, delta_accuracy, delta_completeness, delta_clarity, delta_reflection INTO NAME category VALUE key)
SELECT category, key, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY category), 2) AS percent FROM x GROUP BY category, key"""))
def q_category_delta_distribution(spark, d):
    names = [f"delta_{c}" for c in SCORES]
    long = deltas(spark, d).where("replies >= 2").unpivot("thread", names, "category", "key")
    return report.breakdown(long, ["category"], "key")


@query(sqlfmt("""WITH {scored}, {deltas} SELECT bround_mean AS mean_delta_total, med AS median_delta_total, n AS threads FROM
(SELECT round_even(avg(delta_total), 3) AS bround_mean, round_even(median(delta_total), 3) AS med, count(*) AS n FROM deltas WHERE replies >= 2)"""))
def q_delta_mean_median(spark, d):
    return deltas(spark, d).where("replies >= 2").agg(F.bround(F.avg("delta_total"), 3).alias("mean_delta_total"), F.bround(F.median("delta_total"), 3).alias("median_delta_total"), F.count("*").alias("threads"))


def _by(group: str) -> tuple[str, str]:
    sql = sqlfmt("""WITH {scored}, {deltas}, t AS (SELECT o_orderkey AS thread, c_mktsegment AS service, n_name AS school, o_custkey || ' - ' || c_name AS mentor
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT g AS "group", key, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY g), 2) AS percent
FROM (SELECT coalesce(@G, 'NULL') AS g, delta_total AS key FROM t JOIN deltas USING (thread)) GROUP BY g, key""")
    return sql.replace("@G", group), group


def _delta_by(spark, d, group) -> DataFrame:
    own = {"service": F.col("c_mktsegment"), "school": F.col("n_name"), "mentor": report.label(F.col("o_custkey"), F.col("c_name"))}[group]
    joined = threads(spark, d).join(deltas(spark, d), "thread").select(F.coalesce(own, F.lit("NULL")).alias("group"), bin_half_even(F.col("delta_total")).alias("key"))
    return report.breakdown(joined, ["group"], "key")


@query(_by("service")[0])
def q_delta_by_service(spark, d):
    return _delta_by(spark, d, "service")


@query(_by("school")[0])
def q_delta_by_school(spark, d):
    return _delta_by(spark, d, "school")


@query(_by("mentor")[0])
def q_delta_by_mentor(spark, d):
    return _delta_by(spark, d, "mentor")


@query(sqlfmt("WITH {scored}, {deltas}, p AS (") + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) FILTER (delta_{c} > 0) AS count FROM deltas" for c in SCORES) + """)
SELECT category, count, CASE WHEN sum(count) OVER () = 0 THEN 0.0 ELSE round_even(100.0 * count / sum(count) OVER (), 2) END AS percent FROM p""")
def q_positive_share(spark, d):
    return report.positive_share(deltas(spark, d))


@query(sqlfmt("""WITH {scored}, {deltas} SELECT round_even(CASE WHEN count(*) >= 3 AND stddev_pop(replies) * stddev_pop(delta_total) > 0 THEN covar_pop(replies::DOUBLE, delta_total::DOUBLE) / (stddev_pop(replies) * stddev_pop(delta_total)) END, 4) AS pearson_r, count(*) AS n_pairs FROM deltas WHERE replies >= 2"""))
def q_pearson_replies_delta(spark, d):
    return report.correlation(deltas(spark, d).where("replies >= 2"), "replies", "delta_total")


@query(sqlfmt("""WITH {scored}, {deltas}, {ttr} SELECT round_even(covar_pop(med, delta_total::DOUBLE) / (stddev_pop(med) * stddev_pop(delta_total)), 4) AS pearson_r, count(*) AS n_pairs FROM ttr JOIN deltas USING (thread)"""))
def q_pearson_ttr_delta(spark, d):
    return report.correlation(reply_times(spark, d).join(deltas(spark, d), "thread"), "reply_seconds_median", "delta_total")


@query(sqlfmt("""WITH {ttr}, x AS (SELECT round_even(med / 3600, 0)::BIGINT AS key FROM ttr WHERE med IS NOT NULL)
SELECT 'F' AS section, 'hours' AS "group", key, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM x GROUP BY key"""))
def q_reply_time_hours(spark, d):
    """Threads by the hours of their median reply time; those without one are left out."""
    timed = reply_times(spark, d).where("reply_seconds_median IS NOT NULL")
    return report.distribution(timed, bin_half_even(F.col("reply_seconds_median") / 3600), "F", "hours")


@query("""WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT n AS key, o_orderkey AS member FROM c""")
def q_row_membership(spark, d):
    counted = report.zero_filled_counts(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "n")
    return report.membership(counted, "n", "o_orderkey").select(F.col("n").alias("key"), F.col("o_orderkey").alias("member"))


# ---- maps


@query("SELECT n_name AS school, min(s_suppkey) AS teacher FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def q_teacher_map(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("school"))
    first = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("teacher"))
    return first.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("school", "teacher")


@query("SELECT r_name AS publication, min(trim(n_name)) AS school FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND trim(n_name) <> '' GROUP BY 1")
def q_school_map(spark, d):
    named = table(spark, d, "nation").select("n_regionkey", X.strip_u(F.col("n_name")).alias("school")).where("school <> ''")
    return table(spark, d, "region").join(named, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("publication")).agg(F.min("school").alias("school"))


@query("SELECT c_nationkey AS publication, arg_min(c_mktsegment, c_custkey) AS service FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def q_service_map(spark, d):
    return table(spark, d, "customer").where("c_mktsegment IS NOT NULL").groupBy(F.col("c_nationkey").alias("publication")).agg(F.min_by("c_mktsegment", "c_custkey").alias("service"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q_latest_membership(spark, d):
    return report.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user'")
def q_previous_submission(spark, d):
    return turns(spark, d, "user").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


# ---- threads


@query("""WITH m AS (SELECT conv_id, turn, text, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text, CASE WHEN nr = 'assistant' THEN nt END AS reply FROM m WHERE role = 'user')
SELECT conv_id, string_agg('Submission ' || n || ': ' || coalesce(text, '') || chr(10) || CASE WHEN coalesce(reply, '') = '' THEN '(No reply yet)' ELSE 'Mentor Response ' || n || ': ' || reply END, chr(10) ORDER BY n) AS content FROM u GROUP BY 1""")
def q_thread_document(spark, d):
    return nested_threads(spark, d).select("conv_id", conv.rendered(F.col("conversation"), "short_answer", "response").alias("content"))


@query(sqlfmt("WITH {users} SELECT conv_id, " + ", ".join(f"max(CASE WHEN idx = {i} THEN text END) AS msg_{i}_text" for i in range(4)) + " FROM users GROUP BY 1"))
def q_wide_flatten(spark, d):
    """All messages of the longest thread; the SQL has the columns of the first four."""
    return conv.wide(conv.numbered(turns(spark, d, "user").select("conv_id", "turn", "text"), "conv_id", [F.col("turn")]), "conv_id", "idx", ["text"], 4)


@query(sqlfmt("""WITH {users}, x AS (SELECT conv_id, idx, length(text) % 5 AS s, lag(length(text) % 5) OVER (PARTITION BY conv_id ORDER BY idx) AS p FROM users)
SELECT conv_id, idx::BIGINT AS idx, s AS strategy, CASE WHEN p IS NULL THEN '' WHEN s >= p THEN '+' || (s - p) ELSE '-' || (p - s) END AS strategy_diff FROM x"""))
def q_rubric_delta(spark, d):
    rows = conv.numbered(turns(spark, d, "user").select("conv_id", "turn", F.length("text").cast("bigint").alias("n")), "conv_id", [F.col("turn")])
    rows = rows.select("conv_id", F.col("idx").cast("bigint").alias("idx"), (F.col("n") % 5).alias("strategy"))
    return conv.diffs(rows, "conv_id", "idx", [], ["strategy"])


@query(sqlfmt("""WITH {users}, x AS (SELECT conv_id, length(text) % 5 - min(length(text) % 5) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gain FROM users)
SELECT conv_id FROM x GROUP BY 1 HAVING max(gain) >= 2"""))
def q_improvement_filter(spark, d):
    values = F.transform("conversation", lambda m: m["rubrics"]["strategy"])
    return nested_threads(spark, d).where(conv.best_gain(values) >= 2).select("conv_id")


CONFIG = {
    "short_answer": {"min_length": 40},
    "response": {"min_length": 10, "not_contains": ["zzzz", "qqqq"]},
    "strategy": {"is_rubric": True, "improvement": 1},
    "clarity": {"is_rubric": True, "min_value": 3},
    "mentor_replies": {"is_synthetic": True, "min_value": 1},
}
SHAPE = {"top": ["conv_id"], "inner": ["short_answer", "response"], "rubric": ["strategy", "clarity"]}
_FILTER_SQL = sqlfmt("""WITH m AS (SELECT conv_id, turn, text, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn, text, CASE WHEN nr = 'assistant' THEN nt END AS reply, length(text) % 5 AS strategy, length(text) % 7 AS clarity FROM m WHERE role = 'user'),
g AS (SELECT *, strategy - min(strategy) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gain FROM u),
t AS (SELECT conv_id, bool_or(length(trim(text, E' \\n\\t')) >= 40) AND coalesce(bool_or(length(trim(reply, E' \\n\\t')) >= 10), false)
  AND coalesce(NOT bool_and(lower(reply) LIKE '%zzzz%' OR lower(reply) LIKE '%qqqq%'), false) AND count(*) FILTER (trim(coalesce(reply, ''), E' \\n\\t') <> '') >= 1 AS common,
  coalesce(max(gain) >= 1, false) AS strategy, max(clarity) >= 3 AS clarity FROM g GROUP BY 1) """)


@query(_FILTER_SQL + "SELECT conv_id FROM t WHERE common AND strategy AND clarity")
def q_filter_main(spark, d):
    return filters.kept(nested_threads(spark, d), CONFIG, **SHAPE).select("conv_id")


@query(_FILTER_SQL + "SELECT 'strategy' AS rubric, count(*) FILTER (common AND strategy) AS threads FROM t UNION ALL SELECT 'clarity', count(*) FILTER (common AND clarity) FROM t")
def q_filter_per_rubric(spark, d):
    each = filters.per_rubric(CONFIG, **SHAPE)
    counted = nested_threads(spark, d).agg(*(F.count_if(p).alias(k) for k, p in each.items()))
    return counted.withColumn("_", F.lit(1)).unpivot("_", list(each), "rubric", "threads").select("rubric", "threads")


# ---- categories


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 4).alias("bucket"))
    return docs.join(table(spark, d, "labels"), "doc_id")


@query("""WITH x AS (UNPIVOT (SELECT source, quality, toxic FROM documents JOIN labels USING (doc_id)) ON quality, toxic INTO NAME category VALUE score_level)
SELECT source AS group_value, category, score_level, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source, category), 2) AS percent FROM x GROUP BY source, category, score_level""")
def q_category_breakdown(spark, d):
    long = labelled(spark, d).select(F.col("source").alias("group_value"), "quality", "toxic").unpivot("group_value", ["quality", "toxic"], "category", "score_level").where("score_level IS NOT NULL")
    return report.breakdown(long, ["group_value", "category"], "score_level")


@query("""WITH x AS (UNPIVOT (SELECT (n_chars % 4)::VARCHAR AS bucket_value, quality, toxic FROM documents JOIN labels USING (doc_id)) ON quality, toxic INTO NAME category VALUE score_level)
SELECT bucket_value, category, score_level, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY bucket_value, category), 2) AS percent FROM x GROUP BY bucket_value, category, score_level""")
def q_dist_by_bucket(spark, d):
    long = labelled(spark, d).select(F.col("bucket").cast("string").alias("bucket_value"), "quality", "toxic").unpivot("bucket_value", ["quality", "toxic"], "category", "score_level").where("score_level IS NOT NULL")
    return report.breakdown(long, ["bucket_value", "category"], "score_level")


@query("""WITH b AS (SELECT (n_chars % 4)::VARCHAR AS bucket_value, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)),
f AS (UNPIVOT b ON lang, source INTO NAME factor VALUE factor_value), x AS (UNPIVOT f ON quality, toxic INTO NAME category VALUE score_level)
SELECT bucket_value, factor, factor_value, category, score_level::BIGINT AS score_level, count(*) AS count,
round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY bucket_value, factor, factor_value, category), 2) AS percent FROM x GROUP BY bucket_value, factor, factor_value, category, score_level""")
def q_crossed_dist(spark, d):
    return report.crossed(labelled(spark, d), "bucket", ["lang", "source"], ["quality", "toxic"])


# ---- viewer


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS num_subs, count(*) FILTER (role = 'assistant') AS num_mentor_msgs,
coalesce(median(length(text)) FILTER (role = 'user'), 0)::DOUBLE AS median_short, coalesce(median(length(text)) FILTER (role = 'assistant'), 0)::DOUBLE AS median_mentor,
bool_or(text LIKE '%base64,%') AS has_images FROM conversations GROUP BY 1""")
def q_thread_metrics(spark, d):
    of = lambda r: F.when(F.col("role") == r, F.length("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("num_subs"), F.count_if(F.col("role") == "assistant").alias("num_mentor_msgs"),
        F.coalesce(F.median(of("user")), F.lit(0.0)).alias("median_short"), F.coalesce(F.median(of("assistant")), F.lit(0.0)).alias("median_mentor"),
        F.bool_or(F.contains("text", F.lit("base64,"))).alias("has_images"),
    )


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING bool_or(lower(text) LIKE '%the%') ORDER BY conv_id LIMIT 50 OFFSET 50")
def q_viewer_page(spark, d):
    """Second page of 50 of the threads with a word; the limit is the feature."""
    found = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(F.contains(F.lower("text"), F.lit("the"))).alias("hit")).where("hit")
    return found.select("conv_id", "n").orderBy("conv_id").offset(50).limit(50)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_has_feedback(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_has_no_feedback(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS mentors FROM orders GROUP BY 1")
def q_count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("mentors"))


@query("""SELECT o_orderstatus, count(*) AS messages, count(l_orderkey) AS replies, round(sum(coalesce(l_quantity, 0)), 2) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def q_fanout_join(spark, d):
    joined = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("messages"), F.count("l_orderkey").alias("replies"), F.round(F.sum(F.coalesce("l_quantity", F.lit(0.0))), 2).alias("quantity"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q_outer_to_inner(spark, d):
    left = table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(table(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return left.where("o_orderkey IS NOT NULL").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


# ---- text


@query("SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), E' \\n\\t\\r') AS bare FROM pages")
def q_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_u(F.regexp_replace("html", "<[^>]+>", "")).alias("bare"))


@query()
def q_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"), X.plain_text(F.col("html")).alias("plain"), X.parsed_text(F.col("html")).alias("parsed"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\r|\\n|\\t', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM conversations WHERE text NOT LIKE '%&%'")
def q_sanitize_text(spark, d):
    """All texts, empty for null; the SQL leaves out those with an '&' and null, for it can't decode entities."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(X.sanitize(F.col("text")), F.lit("")).alias("text"))


@query()
def q_sanitize_compat(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.sanitize_compat(t).alias("compat"), X.sanitize_clean(X.fix_mojibake(t)).alias("clean"), X.for_web(t).alias("web"), X.for_web_with_images(t).alias("web_images"), X.for_viewer(t).alias("viewer"))


@query()
def q_word_diff(spark, d):
    rows = conv.numbered(turns(spark, d, "user").select("conv_id", "turn", "text"), "conv_id", [F.col("turn")])
    return conv.diffs(rows, "conv_id", "idx", ["text"], []).select("conv_id", "idx", "text_diff")


@query()
def q_base64_placeholders(spark, d):
    return table(spark, d, "pages").select("page_id", X.image_placeholders(F.lit("Page"), F.col("html")).alias("x")).select("page_id", "x.text", F.size("x.images").alias("images"))


@query(r"""SELECT doc_id, round_even(coalesce(len(regexp_extract_all(text, '\$[^$]+\$|\\\[[\s\S]*?\\\]|\\begin\{equation\}[\s\S]*?\\end\{equation\}|\\frac\{|\\sqrt\{|\\sum|\\int|\\lim|[∀∃∑∫∞≈≃≅≡≤≥√±÷×⋅∠°′″→⇒⇔≈≠∈∉∩∪⊂⊆⊇⊃∅∴∵∝]|[^\p{L}\p{M}\p{N}_]\^[^\s]|_[^\s\p{L}\p{M}\p{N}_]'))
/ greatest(1.0, log10(length(text) + 1)), 0.0), 6) AS score FROM documents""")
def q_mathiness(spark, d):
    return table(spark, d, "documents").select("doc_id", F.bround(X.mathiness(F.col("text")), 6).alias("score"))


@query("SELECT doc_id, sha256(text) AS doc_hash, sha1(text)[:16] AS slug, md5(text) AS log_name FROM documents")
def q_doc_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("doc_hash"), F.substring(F.sha1("text"), 1, 16).alias("slug"), F.md5("text").alias("log_name"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def q_new_docs_anti(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return new_documents(docs, docs.where("source = 'src0'").select(F.sha2("text", 256).alias("doc_hash"))).select("doc_id")


@query("""SELECT doc_id, i::BIGINT AS chunk_idx, substring(text, (i * 462 + 1)::BIGINT, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 50) / 462.0)::BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def q_chunks(spark, d):
    return chunks.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk")


@query()
def q_recursive_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunks.recursive_chunks(F.col("text"))).alias("chunk_idx", "chunk"))
    return rows.withColumn("chunk_id", chunks.chunk_id(F.col("doc_id"), F.col("chunk_idx")))


# ---- vectors

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_TOP = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round({_COS}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) """


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


@query(_TOP + "SELECT query_id, vec_id, round(sim, 4) AS sim, rank FROM t WHERE rank <= 10")
def q_topk(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    corpus = vecs(spark, d)
    return vectors.top_k(corpus.where("id % 50 = 0"), corpus, 10).select("query_id", "vec_id", F.round("sim", 4).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label % 2 AS store, round({_COS}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, store ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(sum(0.5 / (60 + rank)), 8) AS score FROM t WHERE rank <= 10 GROUP BY ALL""")
def q_rrf(spark, d):
    corpus = vecs(spark, d)
    queries = corpus.where("id % 50 = 0")
    ranked = vectors.top_k(queries, corpus.where("label % 2 = 0"), 10).union(vectors.top_k(queries, corpus.where("label % 2 = 1"), 10))
    return vectors.fused(ranked, 0.5).select("query_id", "vec_id", F.round("score", 8).alias("score"))


@query(f"""WITH s AS (SELECT a.vec_id, max(round({_COS}, 6)) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label = 1 GROUP BY 1)
SELECT vec_id, round(sim, 4) AS max_sim FROM s""")
def q_knn_max(spark, d):
    corpus = vecs(spark, d)
    best = vectors.top_k(corpus.where("id % 50 = 0"), corpus.where("label = 1"), 1)
    return best.select(F.col("query_id").alias("vec_id"), F.round("sim", 4).alias("max_sim"))


@query(f"""WITH m AS (SELECT a.label AS a, b.label AS b, avg({_COS}) AS v FROM embeddings a JOIN embeddings b ON a.label <= b.label GROUP BY 1, 2)
SELECT m.a, m.b, round(m.v, 4) AS mean_cosine, round(CASE WHEN m.a = m.b THEN 0.0 ELSE (s.v - m.v) / s.v * 100 END, 2) AS relative_drift_pct FROM m JOIN m s ON s.a = m.a AND s.b = m.a""")
def q_drift_pairs(spark, d):
    """Mean cosine of all pairs of two labels, and the drift of each pair against its first label."""
    means = vectors.mean_cosines(table(spark, d, "embeddings"), "label", "embedding").where("a <= b")
    own = means.where("a = b").select("a", F.col("v").alias("s"))
    drift = F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.col("s") - F.col("v")) / F.col("s") * 100)
    return means.join(own, "a").select("a", "b", F.round("v", 4).alias("mean_cosine"), F.round(drift, 2).alias("relative_drift_pct"))


@query(f"""WITH n AS (SELECT a.vec_id, a.label AS a, b.label AS b, max(round({_COS}, 6)) AS sim FROM embeddings a JOIN embeddings b ON a.label <= b.label GROUP BY 1, 2, 3), m AS (SELECT a, b, avg(sim) AS v FROM n GROUP BY 1, 2)
SELECT m.a, m.b, round(m.v, 4) AS mean_cosine, round(CASE WHEN m.a = m.b THEN 0.0 ELSE (s.v - m.v) / s.v * 100 END, 2) AS relative_drift_pct FROM m JOIN m s ON s.a = m.a AND s.b = m.a""")
def q_drift_nearest(spark, d):
    """Mean cosine of each vector of a label to its nearest among all of another, and the drift of each pair against its first label."""
    means = nearest.label_nearest(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "vec_id", "label", "embedding").groupBy("a", "b").agg(F.avg("sim").alias("v"))
    # each label's own mean by a window over the pairs: a join with them would search twice
    own = means.withColumn("s", F.max(F.when(F.col("a") == F.col("b"), F.col("v"))).over(Window.partitionBy("a"))).where("s IS NOT NULL")
    drift = F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.col("s") - F.col("v")) / F.col("s") * 100)
    return own.select("a", "b", F.round("v", 4).alias("mean_cosine"), F.round(drift, 2).alias("relative_drift_pct"))


@query("SELECT vec_id, 32 AS cut, round(list_sum(embedding[1:32]::DOUBLE[]), 4) AS cut_sum, 80 AS padded, round(list_sum(embedding::DOUBLE[]), 4) AS padded_sum FROM embeddings")
def q_align_truncate_pad(spark, d):
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(vectors.aligned(e, 32)).alias("cut"), total(vectors.aligned(e, 32)).alias("cut_sum"), F.size(vectors.aligned(e, 80)).alias("padded"), total(vectors.aligned(e, 80)).alias("padded_sum"))


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
b AS (SELECT least(floor((value - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, lo, hi, n FROM events, r)
SELECT bin, count(*) AS count, round(count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 50)), 6) AS density FROM b GROUP BY bin""")
def q_histogram50(spark, d):
    return report.histogram(table(spark, d, "events"), "value", 50)


# ---- JSON, training pairs, scoring


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL AND json_valid(props)")
def q_json_feedback(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("entry")).where("entry IS NOT NULL")
    return parsed.select("event_id", F.try_variant_get("entry", "$.k", "bigint").alias("k"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def q_llm_json_extract(spark, d):
    said = F.concat(F.lit("Here is the answer: "), "props", F.lit(" I hope it helps."))
    return table(spark, d, "events").select("event_id", X.greedy_json(said, "k bigint")["k"].alias("k"))


@query()
def q_first_json(spark, d):
    return table(spark, d, "events").select("event_id", X.extract_json(F.concat(F.lit("Sure: "), "props")).alias("answer"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'Reply to the student.' AS instruction, trim(text, E' \\n\\t') AS input, trim(nt, E' \\n\\t') AS output FROM m WHERE role = 'user' AND nr = 'assistant' AND trim(text, E' \\n\\t') <> '' AND trim(nt, E' \\n\\t') <> ''""")
def q_sft_examples(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", X.strip_u(F.col("text")).alias("input"), F.lead("role").over(w).alias("next"), X.strip_u(F.lead("text").over(w)).alias("output"))
    kept = rows.where("role = 'user' AND next = 'assistant' AND input <> '' AND output <> ''")
    return kept.select("conv_id", "turn", F.lit("Reply to the student.").alias("instruction"), "input", "output")


@query()
def q_mrubric_scores(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("clarity", T.LongType()), T.StructField("accuracy", T.LongType()), T.StructField("comment", T.StringType())])
    replies = turns(spark, d, "assistant").select(F.concat_ws("-", "conv_id", "turn").alias("reply"), F.concat(F.lit("Score this reply: "), "text").alias("prompt"))
    return scoring.scored(replies, "reply", "prompt", scoring.fake_client, schema)


@query("""SELECT event_type AS model, count(*) FILTER (value > 20) AS successes, count(*) FILTER (NOT value > 20) AS errors,
round(coalesce(sum(value) FILTER (value > 20), 0) / greatest(count(*) FILTER (value > 20), 1), 6) AS avg_latency FROM events GROUP BY 1""")
def q_usage_stats(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("value") > 20).alias("ok"), "value")
    return scoring.usage(calls, "model", "ok", "value").withColumn("avg_latency", F.round("avg_latency", 6))


@query("SELECT source, count(DISTINCT sha256(text)) AS documents, count(*) AS rows, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM documents GROUP BY 1")
def q_source_sets(spark, d):
    counted = table(spark, d, "documents").groupBy("source").agg(F.count_distinct(F.sha2("text", 256)).alias("documents"), F.count("*").alias("rows"))
    return counted.withColumn("percent", percent(F.col("rows"), F.sum("rows").over(Window.partitionBy(F.lit(0)))))


from . import reports, retrieval, viewer  # noqa: E402, F401  they register their queries
