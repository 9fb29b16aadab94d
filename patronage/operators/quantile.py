"""Exact quantiles of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

# Values between two brackets that one task may sort.
SMALL = 100_000
# Rank error of the sketch is at most rows / ACCURACY.
ACCURACY = 10_000


def exact_quantile(df: DataFrame, column: str, q: float, small: int = SMALL) -> float | None:
    """Quantile with linear interpolation between the two nearest values."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile must be between 0 and 1, got {q}")
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if n == 0:
        return None
    position = (n - 1) * q
    below, above = math.floor(position), math.ceil(position)
    v_below = _order_statistic(values, below + 1, n, low, high, small)
    v_above = v_below if above == below else _order_statistic(values, above + 1, n, low, high, small)
    return v_below + (v_above - v_below) * (position - below)


def _order_statistic(values, rank, n, low, high, small):
    """The value of 1-based ``rank``.

    A sketch gives two values that enclose it; rows outside them are counted,
    not kept.  The enclosed part shrinks by a factor of thousands per pass and
    is sorted only once it is small.  Values held by many rows end up as one
    of the two ends, which needs no sorting.
    """
    if rank == 1:
        return low
    if rank == n:
        return high
    while n > small:
        p = (rank - 0.5) / n
        margin = 2 / ACCURACY
        low, high = values.agg(
            F.percentile_approx("v", [max(p - margin, 0.0), min(p + margin, 1.0)], ACCURACY)
        ).first()[0]
        under, upto, inside = values.agg(
            F.count_if(F.col("v") < low),
            F.count_if(F.col("v") <= low),
            F.count_if((F.col("v") > low) & (F.col("v") < high)),
        ).first()
        if under < rank <= upto:
            return low
        if rank <= under:
            values, n = values.filter(F.col("v") < low), under
        elif rank <= upto + inside:
            values, n, rank = values.filter((F.col("v") > low) & (F.col("v") < high)), inside, rank - upto
        else:
            at_high = values.filter(F.col("v") == high).count()
            if rank <= upto + inside + at_high:
                return high
            rank -= upto + inside + at_high
            n -= upto + inside + at_high
            values = values.filter(F.col("v") > high)
    # By its number: interpolation at (rank - 1) / (n - 1) would not always return to the rank.
    return values.orderBy("v").limit(rank).agg(F.max("v")).first()[0]
