"""Numeric columns with the rounding rules that reports need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, half-even at `digits`; 0.0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(100.0 * part / F.nullif(whole, F.lit(0)), digits)).cast("double")


def bin_half_even(value: Column) -> Column:
    """The nearest integer, halves to the even one."""
    return F.bround(value).cast("bigint")


def pearson(x: Column, y: Column, digits: int = 4) -> Column:
    """Pearson's r as an aggregate; null for fewer than three pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.bround(F.when(F.count(a) >= 3, r), digits)
