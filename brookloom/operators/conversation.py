"""Threads as nested documents, their rendering as text, and operators on the order of messages."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signed_delta, word_diff

RUBRIC_LINE = "Rubric"


def messages(submissions: DataFrame, responses: DataFrame, rubrics: DataFrame | None = None) -> DataFrame:
    """A row for each submission and response to it; a submission without one stays."""
    out = submissions.join(responses, "submission_id", "left")
    return out if rubrics is None else out.join(rubrics, "rubric_id", "left")


def numbered(df: DataFrame, thread: str, order: list[Column], name: str = "idx") -> DataFrame:
    """The place of each message in its thread, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(thread).orderBy(*order)) - 1)


def nested(df: DataFrame, thread: str, idx: str, fields: list[str]) -> DataFrame:
    """A row for each thread with its messages as an ordered array."""
    entry = F.struct(idx, *fields)
    return df.groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda m: F.struct(*(m[f].alias(f) for f in fields))).alias("conversation"))


def rendered(conversation: Column, question: str, answer: str) -> Column:
    """Lines of a thread: numbered questions, answers or '(No reply yet)'."""

    def lines(m: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        reply = F.when(F.coalesce(m[answer], F.lit("")) == "", "(No reply yet)").otherwise(F.concat(F.lit("Mentor Response "), n, F.lit(": "), m[answer]))
        return F.array(F.concat(F.lit("Submission "), n, F.lit(": "), F.coalesce(m[question], F.lit(""))), reply)

    return F.array_join(F.flatten(F.transform(conversation, lines)), "\n")


def exported(conversation: Column, *, problem: Column, student: Column, age: Column, school: Column, mentor: Column, scores: list[str]) -> Column:
    """A thread as a text file: a header of what is known, then both answers, the reply, images and scores of each message, an empty line after each part."""
    known = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    blank = F.lit("")
    about = [known("Student Name", student), known("Age", age), known("School", school)]
    by = known("Mentor Name", mentor)
    head = F.array(F.concat(F.lit("Problem statement: "), F.coalesce(problem, blank)), blank, *about, blank, by, F.when(by.isNotNull(), blank))

    def dated(word: str, date: Column) -> Column:
        return F.coalesce(F.when(date != "", F.concat(F.lit(f"({word} on "), date, F.lit(") "))), blank)

    def lines(m: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        sent = dated("submitted", m["submission_date"])
        answers = [F.concat(F.lit("Student Submission "), sent, F.lit(f"{kind} Answer "), n, F.lit(": "), F.coalesce(m[f"{kind.lower()}_answer"], blank)) for kind in ("Short", "Long")]
        reply = F.coalesce(m["response"], blank)
        response = F.when(reply == "", "Mentor Response: (No reply yet)").otherwise(F.concat(F.lit("Mentor Response "), dated("responded", m["response_date"]), n, F.lit(": "), reply))
        images = F.transform(m["images"], lambda x: F.concat(F.lit("Embedded image: "), x["field"], F.lit(" Image "), x["index"].cast("string"), F.lit(" "), x["base64"]))
        given = F.array_compact(F.array(*(F.concat(F.lit(f"{s.capitalize()}: "), m["rubrics"][s].cast("string")) for s in scores)))
        scored = F.when(F.size(given) > 0, F.array(F.concat(F.lit("Rubric "), n, F.lit(": "), F.array_join(given, "; ")), blank))
        none = F.array().cast("array<string>")
        return F.concat(F.array(answers[0], blank, answers[1], blank, response, blank), F.when(F.size(images) > 0, F.concat(images, F.array(blank))).otherwise(none), F.coalesce(scored, none))

    return F.array_join(F.concat(F.array_compact(head), F.flatten(F.transform(conversation, lines))), "\n")


def with_previous(df: DataFrame, thread: str, idx: str, columns: list[str]) -> DataFrame:
    """prev_<column> of the message before."""
    w = Window.partitionBy(thread).orderBy(idx)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def diffs(df: DataFrame, thread: str, idx: str, texts: list[str], scores: list[str]) -> DataFrame:
    """<text>_diff and <score>_diff against the message before; empty for the first."""
    out = with_previous(df, thread, idx, [*texts, *scores])
    first = F.col(idx) == 0
    added = {f"{t}_diff": F.when(first, "").otherwise(word_diff(F.col(f"prev_{t}"), F.col(t))) for t in texts}
    added |= {f"{s}_diff": F.when(first, "").otherwise(signed_delta(F.col(f"prev_{s}").cast("string"), F.col(s).cast("string"))) for s in scores}
    return out.withColumns(added).drop(*(f"prev_{c}" for c in [*texts, *scores]))


def wide(df: DataFrame, thread: str, idx: str, fields: list[str], least: int = 1) -> DataFrame:
    """One row for each thread with msg_<i>_<field> of its messages, for tables at the edge: as many as the longest thread has, `least` at least.

    The messages of a thread are gathered once and taken by place.  For long threads see `wide_lines`.
    """
    most = max(least, (df.agg(F.max(idx)).first()[0] or 0) + 1)
    placed = F.map_from_entries(F.collect_list(F.struct(F.col(idx), F.struct(*fields))))
    rows = df.groupBy(thread).agg(placed.alias("_m"))
    return rows.select(thread, *(F.try_element_at("_m", F.lit(i).cast(df.schema[idx].dataType))[f].alias(f"msg_{i}_{f}") for i in range(most) for f in fields))


def wide_lines(df: DataFrame, thread: str, idx: str, fields: list[str], least: int = 1) -> DataFrame:
    """`wide` as lines of CSV (value), a header before the lines of each partition, for threads of any length.

    Lines are written as threads come, so their number of columns is a length, not a number of expressions.
    """
    most = max(least, (df.agg(F.max(idx)).first()[0] or 0) + 1)
    rows = df.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("_at"), *fields))).alias("_m"))
    header = [thread, *(f"msg_{i}_{f}" for i in range(most) for f in fields)]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = []
            if first and batch.num_rows:
                out.append(_line(header))
                first = False
            for key, messages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells: list = [""] * (most * len(fields))
                for m in messages:
                    cells[m["_at"] * len(fields) : (m["_at"] + 1) * len(fields)] = [m[f] for f in fields]
                out.append(_line([key, *cells]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return rows.mapInArrow(lines, "value string")


def _line(cells: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def best_gain(values: Column) -> Column:
    """The largest later minus earlier value of an array, nulls left out; null for fewer than two.  One fold."""
    start = F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("gain"))
    step = lambda s, v: F.struct(F.least(s["low"], v).alias("low"), F.greatest(s["gain"], v - s["low"]).alias("gain"))
    return F.aggregate(F.filter(values.cast("array<double>"), lambda v: v.isNotNull()), start, step, lambda s: s["gain"])
