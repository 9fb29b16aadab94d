"""Null-aware aggregates and ratios.

The metrics follow dataframe conventions for missing data: a group whose values
are all missing sums to zero, missing keys form no group, and NaN counts as
missing.  Spark differs on each of these, so the rules live here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def total(col: str | Column) -> Column:
    """Sum in which an all-null group is 0.0 rather than NULL."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient that is NULL for a zero denominator, also under ANSI mode."""
    return F.try_divide(numerator, denominator)


def known(*names: str) -> Column:
    """True when every named column is present."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def nan_to_null(col: Column) -> Column:
    return F.nanvl(col, F.lit(None).cast("double"))
