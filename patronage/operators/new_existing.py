"""New versus existing customers.

A purchase is *New* in the month of the customer's first purchase and
*Existing* in every other month.  Purchases without a customer or without a
date are Existing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import SHORT_MONTH, month_key, month_label
from ..functions.nulls import known
from ..sources import Base
from .growth import labelled, labelled_months

NEW, EXISTING = "New", "Existing"


def _is_new(first_date, ym, month_format):
    same_month = month_key(first_date, month_format) == ym
    return F.when(F.col("customer").isNotNull() & same_month, NEW).otherwise(EXISTING)


def typed_activity(measures: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    """Customer, segment and month with the purchase type.

    The window runs after the reduction, where a customer has at most one row
    per segment and month however many purchases it made.
    """
    reduced = measures.groupBy("customer", "customer_segment", "ym").agg(
        F.min("first_date").alias("first_date")
    )
    first = F.min("first_date").over(Window.partitionBy("customer"))
    kind = _is_new(F.col("first"), F.col("ym"), month_format)
    return reduced.withColumn("first", first).select("customer", "customer_segment", "ym", kind.alias("type"))


def typed_rows(base: Base) -> DataFrame:
    """Bound rows with ``first_purchase`` (the month of it) and ``type``.

    First dates are aggregated and joined back rather than taken by a window,
    so that a customer with very many rows is not sorted in one task.
    """
    fmt = base.month_format
    typed = base.rows_with(base.first_dates)
    return typed.withColumns(
        {
            "first_purchase": month_label(month_key(F.col("first_date"), fmt), fmt),
            "type": _is_new(F.col("first_date"), month_key(F.col("date"), fmt), fmt),
        }
    ).drop("first_date")


def _customer_months(typed: DataFrame) -> DataFrame:
    """One row per customer and month; the type is the same in all segments.

    The frame is laid out by customer already, so this does not shuffle, and
    counting its rows counts customers without a distinct aggregate.
    """
    return typed.filter(known("ym")).select("customer", "ym", "type").distinct()


def count(typed: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    """Distinct customers by month and type."""
    by_type = _customer_months(typed).groupBy("ym", "type").agg(F.count("customer").alias("count type"))
    return labelled_months(by_type, month_format, "type")


def month_new_percent(typed: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    """Months with existing and new customers and the ratio New / Existing."""
    return labelled_months(_new_percent(_customer_months(typed), "ym"), month_format)


def type_percent(typed: DataFrame) -> DataFrame:
    """Share of each type; a customer that came back counts in both."""
    by_type = typed.groupBy("type").agg(F.count_distinct("customer").alias("n"))
    # Two rows at most, so a window over all of them is bounded.
    everything = Window.partitionBy(F.lit(0))
    share = F.coalesce(F.try_divide("n", F.sum("n").over(everything)), F.lit(0.0))
    return by_type.select("type", share.alias("type_percent")).sortWithinPartitions("type")


def segment_count(typed: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    """Distinct customers by month, type and segment."""
    by_type = (
        typed.filter(known("ym", "customer_segment"))
        .groupBy("ym", "type", "customer_segment")
        .agg(F.count("customer").alias("customer"))
    )
    return labelled(by_type, month_format, "type", "customer_segment")


def segment_monthly_new_percent(typed: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    """:func:`month_new_percent` per segment."""
    known_segments = typed.filter(known("ym", "customer_segment"))
    return labelled(_new_percent(known_segments, "ym", "customer_segment"), month_format, "customer_segment")


def _new_percent(typed: DataFrame, *keys: str) -> DataFrame:
    """Customers by type side by side; rows are distinct customers of a group.

    A type without any row gives 0 percent.  One whose rows all lack a customer
    counts zero customers, and new customers over it are infinitely many.
    """
    counts = {t: F.count(F.when(F.col("type") == t, F.col("customer"))) for t in (EXISTING, NEW)}
    grouped = typed.groupBy(*keys).agg(
        counts[EXISTING].alias(EXISTING),
        counts[NEW].alias(NEW),
        F.bool_or(F.col("type") == EXISTING).alias("has_existing"),
    )
    quotient = (
        F.when(~F.col("has_existing") | (F.col(NEW) == 0), 0.0)
        .when(F.col(EXISTING) == 0, float("inf"))
        .otherwise(F.try_divide(NEW, EXISTING))
    )
    return grouped.withColumn("New Percent", quotient).drop("has_existing")
