"""Revenue and customer totals, overall, per customer and per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import known, ratio, total


def totals(measures: DataFrame) -> DataFrame:
    """One row: total revenue, distinct customers, mean revenue per customer.

    The mean of the per-customer sums equals the revenue of known customers
    over their number, so all three come from a single aggregation.
    """
    customers = F.count_distinct("customer")
    of_known = total(F.when(F.col("customer").isNotNull(), F.col("sale")))
    return measures.agg(
        total("sale").alias("total_revenue"),
        customers.alias("unique_customer"),
        ratio(of_known, customers).alias("avg_customer_revenue"),
    )


def total_revenue(measures: DataFrame) -> DataFrame:
    return measures.agg(total("sale").alias("total_revenue"))


def unique_customer(measures: DataFrame) -> DataFrame:
    return measures.agg(F.count_distinct("customer").alias("unique_customer"))


def avg_customer_revenue(measures: DataFrame) -> DataFrame:
    return totals(measures).select("avg_customer_revenue")


def customer_revenue(measures: DataFrame) -> DataFrame:
    """Revenue per customer, ascending."""
    return (
        measures.filter(known("customer"))
        .groupBy("customer")
        .agg(total("sale").alias("sale"))
        .orderBy("sale", "customer")
    )


def segment_revenue(measures: DataFrame) -> DataFrame:
    """Revenue per segment and its share of the revenue of all known segments."""
    revenue = (
        measures.filter(known("customer_segment"))
        .groupBy("customer_segment")
        .agg(total("sale").alias("sale"))
    )
    return _with_share(revenue, "sale").orderBy("sale", "customer_segment")


def segment_unique_customer(measures: DataFrame) -> DataFrame:
    """Distinct customers per segment and their share.

    A customer of several segments counts in each, so the shares are of the
    sum of the counts.
    """
    customers = (
        measures.filter(known("customer_segment"))
        .groupBy("customer_segment")
        .agg(F.count_distinct("customer").alias("customer"))
    )
    return _with_share(customers, "customer").orderBy("customer", "customer_segment")


def _with_share(reduced: DataFrame, value: str) -> DataFrame:
    # A scalar subquery instead of a window over everything: the number of
    # segments is not bounded, and the subquery reuses the shuffle of the groups.
    whole = reduced.agg(F.sum(value)).scalar()
    return reduced.withColumn("percent", ratio(F.col(value), whole))
