"""Month-to-month retention.

A customer is active in a month when its net sales of the month are positive,
and retained when it was also active in the previous month in which anybody
bought.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import SHORT_MONTH, month_label
from ..functions.nulls import known, ratio
from .materialize import materialize

TOTAL, RETAINED, RATE = "Total unique customer", "Retained customer", "Retention rate"


def activity_long(measures: DataFrame) -> DataFrame:
    """Customer, month and whether the customer was active; one row per observed pair."""
    net = F.coalesce(F.sum("sale"), F.lit(0.0))
    return (
        measures.filter(known("customer", "ym"))
        .groupBy("customer", "ym")
        .agg((net > 0).cast("int").alias("active"))
    )


def by_customer(measures: DataFrame, month_format: str = SHORT_MONTH, months: list | None = None) -> DataFrame:
    """Matrix of customers by months with 1 for active.

    The months become columns, so they must be known: pass them, or they are
    read first (month keys are bounded by the calendar, not by the data).
    """
    long = activity_long(measures)
    if months is None:
        # The months come from the reduced frame, which is kept, so the source is read once.
        long = materialize(long)
        ordered = long.select("ym").distinct().orderBy("ym").select(month_label("ym", month_format))
        months = [row[0] for row in ordered.collect()]
    long = long.withColumn("y_m", month_label("ym", month_format))
    if not months:
        return long.select("customer").distinct()
    return long.groupBy("customer").pivot("y_m", months).agg(F.max("active")).fillna(0, months)


def by_month(measures: DataFrame, month_format: str = SHORT_MONTH) -> DataFrame:
    """Active and retained customers and the retention rate per observed month.

    Each customer-month carries the customer's previous active month.  Counting
    those pairs leaves at most months x months rows, on which "the previous
    observed month" is a lag; the customers themselves are read once.
    """
    before = Window.partitionBy("customer").orderBy("ym").rowsBetween(Window.unboundedPreceding, -1)
    active_month = F.when(F.col("active") == 1, F.col("ym"))
    pairs = (
        activity_long(measures)
        .withColumn("came_from", F.last(active_month, ignorenulls=True).over(before))
        .groupBy("ym", "came_from")
        .agg(F.sum("active").alias("n"))
    )
    arrivals = F.map_from_entries(F.collect_list(F.when(known("came_from"), F.struct("came_from", "n"))))
    months = pairs.groupBy("ym").agg(F.sum("n").alias(TOTAL), arrivals.alias("arrivals"))
    calendar = Window.partitionBy(F.lit(0)).orderBy("ym")
    retained = F.coalesce(F.try_element_at("arrivals", F.lag("ym").over(calendar)), F.lit(0))
    result = months.withColumn(RETAINED, retained).withColumn(RATE, ratio(RETAINED, TOTAL))
    # The window has brought the months together, in order.
    return result.sortWithinPartitions("ym").select(
        month_label("ym", month_format).alias("y_m"), TOTAL, RETAINED, RATE
    )


def by_month_long(monthly: DataFrame) -> DataFrame:
    """The two counts of :func:`by_month` in long form."""
    return monthly.unpivot("y_m", [TOTAL, RETAINED], "type", "count")
