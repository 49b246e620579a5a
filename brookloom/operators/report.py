"""Distribution reports: histograms with percentages, breakdowns, shares, correlations, memberships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bin_half_even, pearson, percent
from ..functions.text import safe_name
from ..sources.zips import write_archives

#: The six rubric categories.
RUBRIC = ["strategy", "interpretation", "accuracy", "completeness", "clarity", "reflection"]


def zero_filled_counts(entities: DataFrame, facts: DataFrame, key: str, fact_key: str, name: str) -> DataFrame:
    """How many facts each entity has, 0 included.  Facts are counted before they meet the entities."""
    counted = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias(name))
    return entities.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def distribution(df: DataFrame, key: Column, section: str, group: str) -> DataFrame:
    """section, group, key, count and percent of all rows; the window runs over one row for each key."""
    counted = df.groupBy(key.alias("key")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counted.select(F.lit(section).alias("section"), F.lit(group).alias("group"), "key", "count", percent(F.col("count"), total).alias("percent"))


def breakdown(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """groups, key, count and percent within the groups."""
    counted = df.groupBy(*groups, key).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*groups))
    return counted.select(*groups, key, "count", percent(F.col("count"), total).alias("percent"))


def first_last_deltas(scored: DataFrame, thread: str, order: list[str], categories: list[str] = RUBRIC) -> DataFrame:
    """Last minus first score of each category by thread, their total, and the number of scored replies.

    Missing scores count as 0.  Both ends come from one aggregation; `order` must break all ties that matter.
    """
    scores = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in categories))
    when = F.struct(*order)
    ends = scored.groupBy(thread).agg(F.min_by(scores, when).alias("first"), F.max_by(scores, when).alias("last"), F.count("*").alias("replies"))
    each = {f"delta_{c}": (F.col(f"last.{c}") - F.col(f"first.{c}")).cast("bigint") for c in categories}
    out = ends.select(thread, "replies", *(v.alias(k) for k, v in each.items()))
    return out.withColumn("delta_total", reduce(lambda a, b: a + b, (F.col(k) for k in each)))


def positive_share(deltas: DataFrame, categories: list[str] = RUBRIC) -> DataFrame:
    """category, count of threads with a positive delta, and its percent of the counts of all categories, in one pass."""
    sums = deltas.agg(*(F.count_if(F.col(f"delta_{c}") > 0).alias(c) for c in categories))
    long = sums.withColumn("n", reduce(lambda a, b: a + b, (F.col(c) for c in categories))).unpivot("n", categories, "category", "count")
    return long.select("category", F.col("count").cast("bigint").alias("count"), percent(F.col("count"), F.col("n")).alias("percent"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """pearson_r (4 digits; null under three pairs or for a constant side) and n_pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(pearson(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson_r"), F.count("*").alias("n_pairs"))


def reply_seconds(replies: DataFrame, thread: str, seconds: str) -> DataFrame:
    """Median and mean reply seconds by thread."""
    return replies.groupBy(thread).agg(F.median(seconds).alias("reply_seconds_median"), F.avg(seconds).alias("reply_seconds_mean"))


def hours_bin(seconds: Column) -> Column:
    """The nearest hour as text, NULL as text where there is none."""
    return F.coalesce(bin_half_even(seconds / 3600).cast("string"), F.lit("NULL"))


def membership(df: DataFrame, key: str, member: str) -> DataFrame:
    """The distinct members of each key, a row for each: a key may have any number of them."""
    return df.select(key, member).distinct()


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def crossed(df: DataFrame, bucket: str, factors: list[str], categories: list[str]) -> DataFrame:
    """bucket, factor, factor_value, category, score_level, count, percent of all crossings, in one aggregation."""
    cells = F.explode(
        F.flatten(F.array(*(F.array(*(F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f).cast("string"), F.lit("NULL")).alias("factor_value"), F.lit(c).alias("category"), F.col(c).cast("bigint").alias("score_level")) for c in categories)) for f in factors)))
    )
    long = df.select(F.coalesce(F.col(bucket).cast("string"), F.lit("NULL")).alias("bucket_value"), cells.alias("x")).select("bucket_value", "x.*").where("score_level IS NOT NULL")
    counted = long.groupBy("bucket_value", "factor", "factor_value", "category", "score_level").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("bucket_value", "factor", "factor_value", "category"))
    return counted.withColumn("percent", percent(F.col("count"), total))


def display_name(first: Column, last: Column, user: Column, key: Column) -> Column:
    """First and last name, else the user name, else user_<id>."""
    full = F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(user, F.lit("")), F.concat(F.lit("user_"), key.cast("string")))


def label(key: Column, name: Column) -> Column:
    """'<id> - <name>', '<id>' without a name, 'NULL' without an id."""
    named = name.isNotNull() & (F.trim(name) != "")
    return F.when(key.isNull(), "NULL").when(named, F.concat(key.cast("string"), F.lit(" - "), name)).otherwise(key.cast("string"))


def not_deleted(column: Column, ignore_deleted: bool) -> Column:
    return F.coalesce(column, F.lit(0)) == 0 if ignore_deleted else F.lit(True)


def histogram(df: DataFrame, value: str, bins: int, digits: int = 6) -> DataFrame:
    """bin, count and density of equal bins between the least and the largest value.  Nulls, NaN and infinite values are left out; a constant column is one bin of width 1; none without values."""
    finite = F.abs(F.col(value).cast("double")) < float("inf")  # NaN is larger
    known = df.where(F.col(value).isNotNull() & finite).select(value)
    ends = known.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))  # one row
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    binned = known.crossJoin(F.broadcast(ends)).withColumn("_width", width)
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_width")), F.lit(bins - 1)).cast("bigint")
    counted = binned.groupBy(place.alias("bin"), "_n", "_width").agg(F.count("*").alias("count"))
    return counted.select("bin", "count", F.round(F.col("count") / (F.col("_n") * F.col("_width")), digits).alias("density"))


#: The columns of a report.
COLUMNS = {"section": "string", "group": "string", "key": "string", "count": "bigint", "percent": "double", "metric": "string", "value": "double", "category": "string"}


def report_rows(df: DataFrame) -> DataFrame:
    """df in the columns of a report; those it doesn't have are null."""
    return df.select(*((F.col(f"`{c}`").cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()))


def assembled(parts: list[DataFrame]) -> DataFrame:
    """All sections of a report as one table."""
    return reduce(DataFrame.unionByName, map(report_rows, parts))


def metrics(df: DataFrame, section: str, group: str, names: list[str]) -> DataFrame:
    """A row with metric and value for each of some columns of a one-row table."""
    values = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return df.select(F.explode(F.array(*values)).alias("_m")).select(F.lit(section).alias("section"), F.lit(group).alias("group"), "_m.metric", "_m.value")


def in_order(df: DataFrame) -> DataFrame:
    """Report rows by section and group, keys ascending as numbers, rows without a key last."""
    return df.orderBy("section", "group", F.try_to_number(F.col("key"), F.lit("S9999999999")).asc_nulls_last(), F.asc_nulls_last("key"), F.asc_nulls_last("metric"))


# ---- the whole report in one pass

#: Section names of the report.
SECTIONS = {
    "replies": ("A. mentor_replies_distribution", "E1. mentor_replies_by_service", "E4. mentor_replies_by_mentor", "E7. mentor_replies_by_school"),
    "revisions": ("B. student_revisions_distribution", "E2. student_revisions_by_service", "E5. student_revisions_by_mentor", "E8. student_revisions_by_school"),
    "total": ("C. total_score_improvement_distribution", "E3. total_score_improvement_by_service", "E6. total_score_improvement_by_mentor", "E9. total_score_improvement_by_school"),
    "category": ("C. {}_improvement_distribution", "E3_cat.{}_by_service", "E6_cat.{}_by_mentor", "E9_cat.{}_by_school"),
    "scored": "C. scored_threads_summary",
    "summary": "C. total_score_improvement_summary",
    "share": "C. category_positive_improvement_share",
    "by_replies": "D. correlation_replies_vs_score_change",
    "by_revisions": "D. correlation_revisions_vs_score_change",
    "hours": "F. time_to_reply_median_hours_distribution",
    "by_time": "F. correlation_reply_time_vs_score_change",
}
FACTORS = ["service_name", "mentor_label", "school_name"]


def thread_features(messages: DataFrame, thread: str, *, reply: Column, scored: Column, order: list[Column], seconds: Column, scores: dict[str, Column], carry: list[str]) -> DataFrame:
    """One row for each thread: what the report counts, in one aggregation.

    messages: a row for each reply, and one for a thread without any.  reply: not null where there is one;
    scored: whether it has scores (missing ones count as 0); order: breaks all ties of first and last;
    carry: columns of the thread.  Deltas are null without scored replies, the median without times.
    """
    own = [F.coalesce(c, F.lit(0)).alias(f"_own_{k}") for k, c in scores.items()]
    ranks = [c.alias(f"_at_{k}") for k, c in enumerate(order)]
    rows = messages.select(thread, *carry, reply.isNotNull().alias("_reply"), F.coalesce(scored, F.lit(False)).alias("_scored"), seconds.cast("double").alias("_seconds"), *ranks, *own)
    # two sorts and sums of plain numbers: no state of a thread is an object, so nothing is gathered or packed
    of = Window.partitionBy(thread, *carry)
    in_turn = of.orderBy(F.desc("_scored"), *(f"_at_{k}" for k in range(len(order))), *(f"_own_{k}" for k in scores))
    in_time = of.orderBy(F.asc_nulls_last("_seconds"))
    first = F.col("_scored") & (F.row_number().over(in_turn) == 1)
    last = F.col("_scored") & ~F.coalesce(F.lead("_scored").over(in_turn), F.lit(False))
    numbered = rows.withColumns({"_first": first, "_last": last}).select(thread, *carry, "_reply", "_scored", "_seconds", "_first", "_last", *(f"_own_{k}" for k in scores))
    timed = numbered.withColumns({"_nth": F.row_number().over(in_time), "_n": F.count("_seconds").over(in_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    half = lambda up: F.sum(F.when(F.col("_nth") == F.floor((F.col("_n") + up) / 2), F.col("_seconds") / 2))
    moved = lambda k: F.sum(F.when(F.col("_last"), F.col(f"_own_{k}")).otherwise(0) - F.when(F.col("_first"), F.col(f"_own_{k}")).otherwise(0))
    ends = timed.groupBy(thread, *carry).agg(
        F.count_if("_reply").alias("mentor_reply_count"), F.count_if("_scored").alias("scored_replies"), (half(1) + half(2)).alias("reply_seconds_median"), *(moved(k).alias(f"_moved_{k}") for k in scores))
    each = {f"delta_{k}": F.when(F.col("scored_replies") > 0, F.col(f"_moved_{k}").cast("double")) for k in scores}
    out = ends.withColumns(each).drop(*(f"_moved_{k}" for k in scores))
    return out.withColumn("delta_total", reduce(lambda a, b: a + b, (F.col(k) for k in each)))


def _names(categories: list[str]) -> list[str]:
    """All section names; cells hold places in this list, for they are many and names are long."""
    return [n for v in SECTIONS.values() for own in (v if isinstance(v, tuple) else (v,)) for n in ([own.format(f"delta_{c}") for c in categories] if "{}" in own else [own])]


def _cells(features: DataFrame, categories: list[str], carry: list[str]) -> DataFrame:
    """A row for each cell of the report that counts a thread: section (a place in `_names`), group, key, category, x, y, weight."""
    number_of = {n: k for k, n in enumerate(_names(categories))}
    null, number = F.lit(None), lambda c: F.col(c).cast("double")
    eligible = F.col("delta_total").isNotNull() & (F.col("scored_replies") >= 2)

    def cell(sections, key, *, every=F.lit(True), alone=False, category=None, x=null, y=null):
        names = [sections] * 4 if isinstance(sections, str) else sections
        return F.struct(
            *(F.lit(number_of[n]).alias(f"s{i}") for i, n in enumerate(names)), F.rint(key).cast("bigint").alias("key"), every.alias("every"), F.lit(alone).alias("alone"),
            F.lit(category).cast("string").alias("category"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1).alias("weight"))

    alone = lambda name, key=null, on=None, **more: F.when(on, cell(SECTIONS[name], key.cast("double"), alone=True, **more))
    median = F.col("reply_seconds_median")
    counted = [
        cell(SECTIONS["replies"], number("mentor_reply_count")), cell(SECTIONS["revisions"], number("student_revisions")),
        F.when(F.col("delta_total").isNotNull(), cell(SECTIONS["total"], number("delta_total"), every=eligible)),
        *(F.when(F.col(f"delta_{c}").isNotNull(), cell([n.format(f"delta_{c}") for n in SECTIONS["category"]], number(f"delta_{c}"), every=eligible)) for c in categories),
        alone("scored", on=F.col("scored_replies") >= 2), alone("summary", F.col("delta_total"), on=eligible),
        *(alone("share", on=F.col(f"delta_{c}") > 0, category=c) for c in categories),
        alone("by_replies", on=eligible, x=F.col("mentor_reply_count"), y=F.col("delta_total")), alone("by_revisions", on=eligible, x=F.col("student_revisions"), y=F.col("delta_total")),
        alone("hours", median / 3600, on=median.isNotNull()), alone("by_time", on=median.isNotNull() & F.col("delta_total").isNotNull(), x=median, y=F.col("delta_total")),
    ]
    named = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("NULL")).alias(c) for c in FACTORS]
    cells = features.select(*named, *carry, F.explode(F.array(*counted)).alias("c")).where("c IS NOT NULL")
    place = lambda k, group: F.struct(F.col(f"c.s{k}").alias("section"), group.alias("group"))
    everywhere, by = place(0, F.lit("ALL")), [place(k + 1, F.col(c)) for k, c in enumerate(FACTORS)]
    places = F.when(F.col("c.alone"), F.array(everywhere)).when(F.col("c.every"), F.array(everywhere, *by)).otherwise(F.array(*by))
    return cells.select(*carry, "c", F.explode(places).alias("p")).select(*carry, "p.section", "p.group", "c.key", "c.category", "c.x", "c.y", "c.weight")


def whole_report(features: DataFrame, categories: list[str] = RUBRIC, *, ordered: bool = False) -> DataFrame:
    """All sections of the report (COLUMNS) from one table of features by thread, read once.

    features: mentor_reply_count, student_revisions, scored_replies, delta_<category>, delta_total,
    reply_seconds_median and FACTORS.  A thread makes a row for each cell that counts it; cells are summed
    before they are shuffled, and percents, means, medians and correlations come from the sums.  Sections
    that are there without threads (summaries, shares, correlations) get a row of weight 0.
    ordered: rows in the order of `in_order`.
    """
    cells = _cells(features, categories, [])
    names = _names(categories)
    place = {k: names.index(v) for k, v in SECTIONS.items() if isinstance(v, str)}
    always = [(place[n], None) for n in ("scored", "summary", "by_replies", "by_revisions", "by_time")] + [(place["share"], c) for c in categories]
    empty = features.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("section"), F.lit("ALL").alias("group"), F.lit(None).cast("bigint").alias("key"), F.lit(c).cast("string").alias("category"), *(F.lit(None).cast("double").alias(k) for k in "xy"), F.lit(0).alias("weight")) for n, c in always))).alias("e")).select("e.*")
    # sums of squares and products: there are many cells, and only three have pairs
    moments = {"_x": F.col("x"), "_y": F.col("y"), "_xx": F.col("x") * F.col("x"), "_yy": F.col("y") * F.col("y"), "_xy": F.col("x") * F.col("y")}
    summed = cells.unionByName(empty).groupBy("section", "group", "key", "category").agg(F.sum("weight").alias("count"), F.count("x").alias("_pairs"), *(F.sum(v).alias(k) for k, v in moments.items()))
    n, spread = F.col("_pairs"), lambda xx, x: F.col("_pairs") * F.col(xx) - F.col(x) * F.col(x)
    both = F.sqrt(F.greatest(spread("_xx", "_x"), F.lit(0.0))) * F.sqrt(F.greatest(spread("_yy", "_y"), F.lit(0.0)))
    r = F.when((n >= 3) & (both > 0), F.bround(F.try_divide(n * F.col("_xy") - F.col("_x") * F.col("_y"), both), 4))

    # one string of section and group, apart in its first bytes, serves the shuffle, the window and the order: cells are sorted once
    order = sorted(names)
    marks = F.array(*(F.lit(chr(33 + order.index(name))) for name in names))
    placed = summed.select("section", F.concat(F.element_at(marks, F.col("section") + 1), "group").alias("_at"), "key", "category", "count", "_pairs", r.alias("_r"))
    if ordered:
        placed = placed.repartitionByRange("_at")
    in_group = Window.partitionBy("_at").orderBy(F.asc_nulls_last("key"))
    up_to, group = in_group.rowsBetween(Window.unboundedPreceding, Window.currentRow), in_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = placed.withColumns({"_all": F.sum("count").over(group), "_sum": F.sum(F.col("key") * F.col("count")).over(group), "_to": F.sum("count").over(up_to), "_next": F.lead("key").over(in_group)})
    at = lambda *own: F.col("section").isin(*(place[k] for k in own))
    # the lower of the two middle values has the mean and median of its group; without values, the row of weight 0 has them
    median = F.when(2 * F.col("_to") > F.col("_all"), F.col("key").cast("double")).otherwise((F.col("key") + F.col("_next")) / 2)
    middle = F.when(F.col("_all") == 0, F.col("key").isNull()).otherwise(F.col("key").isNotNull() & (2 * F.col("_to") >= F.col("_all")) & (2 * (F.col("_to") - F.col("count")) < F.col("_all")))
    metric = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("double").alias("percent"))
    rows = (
        F.when(at("scored"), F.array(metric("threads_with_2plus_scored_responses", F.col("count"))))
        .when(at("summary") & middle, F.array(metric("mean_delta_total", F.bround(F.try_divide(F.col("_sum"), F.col("_all")), 3)), metric("median_delta_total", F.bround(median, 3))))
        .when(at("summary"), F.array().cast("array<struct<metric:string,value:double,count:bigint,percent:double>>"))
        .when(at("by_replies", "by_revisions", "by_time"), F.array(metric("n_pairs", F.col("_pairs")), metric("pearson_r", F.col("_r"))))
        .otherwise(F.array(F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("count"), percent(F.col("count"), F.col("_all")).alias("percent"))))
    )
    if ordered:  # metrics of a row are in order above
        table = table.orderBy("_at", F.asc_nulls_last("key"))
    return report_rows(table.select(_name_of(names).alias("section"), F.expr("substring(_at, 2)").alias("group"), F.when(~at("summary"), F.col("key")).alias("key"), "category", F.explode(rows).alias("r")).select("section", "group", "key", "category", "r.*"))


def _name_of(names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col("section") + 1)


def report_members(features: DataFrame, thread: str = "thread", categories: list[str] = RUBRIC) -> DataFrame:
    """section, group, key and thread of every row of a distribution or breakdown in the report: the threads that it counts."""
    names = _names(categories)
    sums = [names.index(SECTIONS[n]) for n in ("scored", "summary", "share", "by_replies", "by_revisions", "by_time")]
    return _cells(features, categories, [thread]).where(~F.col("section").isin(sums) & F.col("key").isNotNull()).select(_name_of(names).alias("section"), "group", "key", thread)


def write_row_archives(features: DataFrame, documents: DataFrame, folder: str, thread: str = "thread", categories: list[str] = RUBRIC, **options) -> DataFrame:
    """An archive for each row of the report with the documents (thread, path, content) of its threads; archive and members.

    Archives that are there are left; a row whose threads have no document has none.
    """
    named = report_members(features, thread, categories).select(archive_name(F.col("section"), F.col("group"), F.col("key")).alias("archive"), thread)
    return write_archives(named.join(documents, thread).select("archive", "path", "content"), folder, **options)


def archive_name(section: Column, group: Column, key: Column) -> Column:
    """The name of the archive of a report row's members."""
    return F.concat(safe_name(F.concat_ws("_", section, group, F.concat(F.lit("key_"), F.coalesce(key.cast("string"), F.lit("NULL"))))), F.lit(".zip"))
