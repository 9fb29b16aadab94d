"""Monthly revenue and monthly active customers, overall and per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import SHORT_MONTH, month_label
from ..functions.nulls import known, total


def labelled(by_month: DataFrame, month_format: str, *others: str) -> DataFrame:
    """Text month keys in front, rows in the order of month and ``others``."""
    values = [c for c in by_month.columns if c != "ym"]
    return by_month.orderBy("ym", *others).select(month_label("ym", month_format).alias("y_m"), *values)


def labelled_months(by_month: DataFrame, month_format: str, *others: str) -> DataFrame:
    """:func:`labelled` for a frame with a few rows per month and nothing else.

    Months are bounded by the calendar, so one task can order them, which saves
    the sampling that a distributed sort starts with.
    """
    values = [c for c in by_month.columns if c != "ym"]
    ordered = by_month.repartition(1).sortWithinPartitions("ym", *others)
    return ordered.select(month_label("ym", month_format).alias("y_m"), *values)


def monthly_revenue(measures: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    by_month = measures.filter(known("ym")).groupBy("ym").agg(total("sale").alias("sale"))
    return labelled_months(by_month, month_format)


def monthly_customer(measures: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    by_month = measures.filter(known("ym")).groupBy("ym").agg(F.count_distinct("customer").alias("customer"))
    return labelled_months(by_month, month_format)


def segment_monthly_revenue(measures: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    by_month = (
        measures.filter(known("ym", "customer_segment"))
        .groupBy("ym", "customer_segment")
        .agg(total("sale").alias("sale"))
    )
    return labelled(by_month, month_format, "customer_segment")


def segment_monthly_customer(measures: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    by_month = (
        measures.filter(known("ym", "customer_segment"))
        .groupBy("ym", "customer_segment")
        .agg(F.count_distinct("customer").alias("customer"))
    )
    return labelled(by_month, month_format, "customer_segment")
