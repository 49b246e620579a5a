"""Threads and submissions as the viewers show them: metrics, searches, pages.  The callers bring their own tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_u

#: An image inside a text, and the thresholds of a search.
IMAGE = r"(?i)data:image/[^;]+;base64,"
LEAST = ["num_subs", "num_mentor_msgs", "num_rubrics", "median_short", "median_long", "median_mentor"]


def thread_metrics(submissions: DataFrame, thread: str, order: str, scores: list[str], *, carry: list[str] | None = None) -> DataFrame:
    """One row for each thread: counts of submissions, scored ones and replies, medians of lengths, images, the first school.

    submissions: short_answer, long_answer, response, school_name and scores by submission; carry: columns of the
    thread.  A null text is an empty one; a reply of white space is none; without a school it is 'Unknown'.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = ["short_answer", "long_answer", "response"]
    middle = lambda c: F.coalesce(F.median(F.length(text(c))), F.lit(0.0))
    scored = reduce(lambda a, b: a | b, (F.col(s).isNotNull() for s in scores))
    return submissions.groupBy(thread, *(carry or [])).agg(
        F.count("*").alias("num_subs"), F.count_if(scored).alias("num_rubrics"), F.count_if(strip_u(text("response")) != "").alias("num_mentor_msgs"),
        middle("short_answer").alias("median_short"), middle("long_answer").alias("median_long"), middle("response").alias("median_mentor"),
        F.bool_or(reduce(lambda a, b: a | b, (F.regexp_like(text(t), F.lit(IMAGE)) for t in texts))).alias("has_images"),
        F.coalesce(F.min_by("school_name", order), F.lit("Unknown")).alias("school_name"))


def _part(column: str, asked: Any, fold: bool = True) -> Column:
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.contains(F.lower(c) if fold else c, F.lit(asked.lower() if fold else asked))


def searched(metrics: DataFrame, asked: dict[str, str], feedback: DataFrame | None = None, thread: str = "thread_id") -> DataFrame:
    """Threads that fit a search form: parts of the id (as it is), puzzle, school and mentor (in any case), least
    counts and medians, and 'yes' or 'no' to images and feedback (rows of another table with the thread's id).

    What is asked as nothing or white space isn't asked; a threshold that is no integer fits no thread.
    """
    asked = {k: v.strip() for k, v in asked.items() if v and v.strip()}
    known = {thread, "puzzle_text", "school_name", "mentor_name", "has_images", "has_feedback", *LEAST}
    if set(asked) - known:
        raise ValueError(f"unknown fields: {sorted(set(asked) - known)}")
    out = metrics
    for field in (thread, "puzzle_text", "school_name", "mentor_name"):
        if field in asked:
            out = out.where(_part(field, asked[field], fold=field != thread))
    for field in LEAST:
        if field in asked:
            try:
                out = out.where(F.col(field) >= int(asked[field]))
            except ValueError:
                out = out.where(F.lit(False))
    wish = {k: asked[k].lower() for k in ("has_images", "has_feedback") if k in asked}
    if wish.get("has_images") in ("yes", "no"):
        out = out.where(F.col("has_images") == (wish["has_images"] == "yes"))
    if wish.get("has_feedback") in ("yes", "no"):
        if feedback is None:
            raise ValueError("there is no feedback to ask for")
        out = out.join(feedback.select(thread), thread, "left_semi" if wish["has_feedback"] == "yes" else "left_anti")
    return out


def page_of(found: DataFrame, order: list[str], page: int, size: int) -> tuple[DataFrame, int, int, int]:
    """The rows of a page, how many there are in all, the page (1 to the last one) and the last one."""
    total = found.count()
    last = max(1, -(-total // size))
    page = max(1, min(page, last))
    return found.orderBy(*order).offset((page - 1) * size).limit(size), total, page, last


def submissions_like(submissions: DataFrame, asked: dict[str, str], scores: list[str]) -> DataFrame:
    """Submissions with total_score, filled and images ('Y' or 'N') that fit a form: parts of the id, puzzle and
    short answer, images Y/N, the least total score (a value that is no number fits none), filled Y/N."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in scores))
    has = reduce(lambda a, b: a & b, (F.coalesce(F.col(c), F.lit("")) != "" for c in ("short_answer", "long_answer", "response")))
    yes = lambda c: F.when(c, "Y").otherwise("N")
    out = submissions.withColumns({"total_score": total, "filled": yes(has), "has_images": yes(F.coalesce(F.size("images") > 0, F.lit(False)))})
    for field, column, fold in (("id", "submission_id", False), ("puzzle", "puzzle_text", True), ("short_answer", "short_answer", True)):
        if asked.get(field):
            out = out.where(_part(column, asked[field], fold))
    if asked.get("images"):
        out = out.where(F.col("has_images") == asked["images"].upper())
    if asked.get("min_score"):
        try:
            out = out.where(F.col("total_score") >= float(asked["min_score"]))
        except ValueError:
            out = out.where(F.lit(False))
    if (asked.get("filled") or "").upper() in ("Y", "N"):
        out = out.where(F.col("filled") == asked["filled"].upper())
    return out
