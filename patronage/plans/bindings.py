"""Bindings of the benchmark tables to customer, segment, sale and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import Base, Dates, Entity, Sale, SegmentTable, bind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_base(spark: SparkSession, sf_dir: str, keep_segments=(), dates: Dates | None = None, **options) -> Base:
    """Orders with the market segment of their customer."""
    customer = table(spark, sf_dir, "customer")
    return bind(
        table(spark, sf_dir, "orders"),
        Entity("o_custkey", keep_segments=list(keep_segments)),
        Sale("o_totalprice"),
        dates or Dates("o_orderdate"),
        segments=SegmentTable(customer, "c_custkey", "c_mktsegment"),
        **options,
    )


def lineitem_base(spark: SparkSession, sf_dir: str) -> Base:
    """One row per line item: price of the item, customer and date of its order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    customer = table(spark, sf_dir, "customer")
    return bind(
        items.join(orders, items.l_orderkey == orders.o_orderkey),
        Entity("o_custkey"),
        Sale("l_extendedprice"),
        Dates("o_orderdate"),
        segments=SegmentTable(customer, "c_custkey", "c_mktsegment"),
    )


def events_base(spark: SparkSession, sf_dir: str) -> Base:
    """Events of a user with the event type as segment; one month, with time of day."""
    return bind(
        table(spark, sf_dir, "events"),
        Entity("user_id", segment="event_type"),
        Sale("value"),
        Dates("ts"),
    )
