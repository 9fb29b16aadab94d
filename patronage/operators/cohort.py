"""Cohorts by month of year.

A customer's cohort is the smallest month number (1..12) in which it bought,
whatever the year, and the index counts months from there, starting at 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import month_of_year
from ..functions.nulls import known, ratio, total

COHORT, INDEX = "Cohort Month", "Cohort Index"
INDEXES = list(range(1, 13))


def cohort_long(measures: DataFrame) -> DataFrame:
    """Revenue, customers and their share of index 1, by cohort and index.

    At most 144 rows.  Reduced to one row per customer and month first, so the
    window holds twelve rows per customer and counting rows counts customers.
    """
    monthly = (
        measures.filter(known("customer", "ym"))
        .groupBy("customer", month_of_year().alias("month"))
        .agg(total("sale").alias("sale"))
    )
    first = F.min("month").over(Window.partitionBy("customer"))
    cells = (
        monthly.withColumn(COHORT, first)
        .withColumn(INDEX, F.col("month") - F.col(COHORT) + 1)
        .groupBy(COHORT, INDEX)
        .agg(F.sum("sale").alias("revenue"), F.count("*").alias("customers"))
    )
    row = Window.partitionBy(COHORT)

    def share(value):
        base = F.max(F.when(F.col(INDEX) == 1, F.col(value))).over(row)
        return ratio(F.col(value), base)

    return cells.withColumns({"revenue_pct": share("revenue"), "retention_pct": share("customers")})


def cohort_table(long: DataFrame, value: str, indexes: list[int] = INDEXES) -> DataFrame:
    """Cohorts as rows, indexes as columns; cells nobody reached are NULL.

    All twelve indexes are columns by default, which needs no look at the data.
    ``indexes=observed_indexes(long)`` leaves out the ones that never occur.
    """
    cells = [F.max(F.when(F.col(INDEX) == i, F.col(value))).alias(str(i)) for i in indexes]
    if not cells:
        return long.select(COHORT).distinct()
    # Twelve rows at most.
    return long.groupBy(COHORT).agg(*cells).repartition(1).sortWithinPartitions(COHORT)


def observed_indexes(long: DataFrame) -> list[int]:
    return [r[0] for r in long.select(INDEX).distinct().orderBy(INDEX).collect()]


def by_revenue(long: DataFrame, indexes: list[int] = INDEXES) -> DataFrame:
    return cohort_table(long, "revenue", indexes)


def by_revenue_pct(long: DataFrame, indexes: list[int] = INDEXES) -> DataFrame:
    return cohort_table(long, "revenue_pct", indexes)


def by_retention(long: DataFrame, indexes: list[int] = INDEXES) -> DataFrame:
    return cohort_table(long, "customers", indexes)


def by_retention_pct(long: DataFrame, indexes: list[int] = INDEXES) -> DataFrame:
    return cohort_table(long, "retention_pct", indexes)
