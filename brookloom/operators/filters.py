"""A filter language: a mapping of fields to rules, compiled to one predicate on nested threads.

Rules are existential and apart: one message may satisfy one rule and another message the next.  A field
is the thread's own column where that isn't null, else the messages' field, else their score of that name.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_u
from .conversation import best_gain

_NUMBER = r"^-?\d+(\.\d+)?$"


def values_of(field: str, top: list[str], inner: list[str], rubric: list[str], conversation: str = "conversation") -> Column:
    """The values of a field in a thread, as texts, nulls left out."""
    messages = F.col(conversation)
    if field in inner and field in rubric:  # the message's own, where it has one
        found = F.transform(messages, lambda m: F.coalesce(m[field].cast("string"), m["rubrics"][field].cast("string")))
    elif field in inner:
        found = F.transform(messages, lambda m: m[field].cast("string"))
    elif field in rubric:
        found = F.transform(messages, lambda m: m["rubrics"][field].cast("string"))
    else:
        found = F.array().cast("array<string>")
    if field in top:
        found = F.when(F.col(field).isNotNull(), F.array(F.col(field).cast("string"))).otherwise(found)
    return F.filter(found, lambda v: v.isNotNull())


def numbers(values: Column) -> Column:
    return F.transform(F.filter(values, lambda v: strip_u(v).rlike(_NUMBER)), lambda v: strip_u(v).cast("double"))


def _any_of(text: Column, needles: Any) -> Column:
    parts = [needles] if isinstance(needles, str) else list(needles)
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(p.lower())) for p in parts), F.lit(False))


def rule_predicate(values: Column, rule: dict[str, Any]) -> Column:
    """Whether the values of one field satisfy a rule; a field without any value doesn't."""
    checks = [F.size(values) > 0]
    if "improvement" in rule:
        checks.append(F.coalesce(best_gain(numbers(values)) >= float(rule["improvement"]), F.lit(False)))
    if "min_value" in rule:
        checks.append(F.coalesce(F.array_max(numbers(values)) >= float(rule["min_value"]), F.lit(False)))
    if "max_value" in rule:
        checks.append(F.coalesce(F.array_min(numbers(values)) <= float(rule["max_value"]), F.lit(False)))
    if "min_length" in rule:
        checks.append(F.exists(values, lambda v: F.length(strip_u(v)) >= int(rule["min_length"])))
    if "max_length" in rule:
        checks.append(F.exists(values, lambda v: F.length(strip_u(v)) <= int(rule["max_length"])))
    if "contains" in rule:
        checks.append(F.exists(values, lambda v: _any_of(v, rule["contains"])))
    if "not_contains" in rule:  # only a thread all of whose values match is rejected
        checks.append(~F.forall(values, lambda v: _any_of(v, rule["not_contains"])))
    if "regex" in rule:
        checks.append(F.exists(values, lambda v: v.rlike(f"(?U)(?d){rule['regex']}")))
    if rule.get("required"):
        checks.append(F.exists(values, lambda v: strip_u(v) != ""))
    return reduce(lambda a, b: a & b, checks)


def reply_count(conversation: str, field: str = "response") -> Column:
    return F.size(F.filter(F.col(conversation), lambda m: F.coalesce(strip_u(m[field]), F.lit("")) != ""))


def compiled(config: dict[str, dict], top: list[str], inner: list[str], rubric: list[str], conversation: str = "conversation", reply: str = "response") -> Column:
    """The whole config as one predicate."""
    out = F.lit(True)
    for field, rule in config.items():
        if rule.get("is_synthetic"):
            n = reply_count(conversation, reply)
            out = out & (n >= int(rule.get("min_value", 0))) & (n <= int(rule.get("max_value", 1 << 30)))
        else:
            out = out & rule_predicate(values_of(field, top, inner, rubric, conversation), rule)
    return out


def per_rubric(config: dict[str, dict], **shape: Any) -> dict[str, Column]:
    """A predicate for each rubric rule: that rule with all rules that aren't of a rubric."""
    common = {f: r for f, r in config.items() if not r.get("is_rubric")}
    return {f: compiled({**common, f: r}, **shape) for f, r in config.items() if r.get("is_rubric")}


def row_predicate(column: str, rule: dict[str, Any]) -> Column:
    """A rule on one text column of a row.  Values that aren't text fail numeric rules, as only texts are parsed."""
    c = F.col(column).cast("string")
    n = F.when(strip_u(c).rlike(_NUMBER), strip_u(c).cast("double"))
    out = F.lit(True)
    for key, value in rule.items():
        if key == "min_length":
            out = out & (F.length(strip_u(c)) >= int(value))
        elif key == "max_length":
            out = out & (F.length(strip_u(c)) <= int(value))
        elif key == "min_value":
            out = out & (n >= float(value))
        elif key == "max_value":
            out = out & (n <= float(value))
        elif key == "contains":
            out = out & _any_of(c, value)
        elif key == "not_contains":
            out = out & ~_any_of(c, value)
        elif key == "regex":
            out = out & c.rlike(f"(?U)(?d){value}")
        elif key == "required" and value:
            out = out & (strip_u(c) != "")
    return F.coalesce(out, F.lit(False))


def kept(threads: DataFrame, config: dict[str, dict], **shape: Any) -> DataFrame:
    return threads.where(compiled(config, **shape))
