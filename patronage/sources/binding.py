"""Bind roles to a DataFrame and expose it at the grains the metrics use."""

from __future__ import annotations

from dataclasses import dataclass
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.storagelevel import StorageLevel

from ..functions.calendar import MONTH_FORMATS, SHORT_MONTH, month_key, month_label
from ..functions.nulls import nan_to_null
from .roles import NO_SEGMENT, Dates, Entity, Sale

# Largest segment table joined as a broadcast.  Larger ones are joined by a
# shuffle, after the facts are reduced.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class SegmentTable:
    """A separate table that maps each entity to its segment."""

    table: DataFrame
    key: str
    segment: str


class Base:
    """The bound table.

    ``rows``
        one row per input row: entity, entity segment, ``sale``, ``date``,
        ``year``, ``month``, ``day``, ``y_m``.
    ``facts``
        the same rows as mergeable measures: ``sale``, ``first_date``,
        ``last_date`` and ``n_dates`` keyed by entity, segment and ``ym``.
    ``activity``
        the measures reduced to one row per entity, segment and month.
    ``measures``
        whichever of the two is cheaper to start a metric from.

    Sum, min, max and count merge, so a metric gives the same result on facts
    and on activity.  Partial aggregation runs before the shuffle, so an entity
    that owns a large share of the rows costs one activity row per month.
    """

    def __init__(self, source, entity, dates, month_format, segments, broadcast_segments):
        self._source = source
        self._segments = segments
        self._broadcast_segments = broadcast_segments
        self._cached = None
        self._table = None
        self.entity = entity
        self.has_dates = dates is not None
        self.month_format = month_format

    @property
    def spark(self):
        return self._source.sparkSession

    def _with_segment(self, df: DataFrame) -> DataFrame:
        if self._segments is None:
            return df
        side = F.broadcast(self._segments) if self._broadcast_segments else self._segments
        return df.join(side, "customer")

    @cached_property
    def rows(self) -> DataFrame:
        return self._present(self._with_segment(self._source))

    def rows_with(self, per_customer: DataFrame) -> DataFrame:
        """Bound rows and the columns of a frame with one row per customer.

        A large segment table is joined to that frame first.  The rows then
        take part in one join, whose skewed side adaptive execution can split;
        with two joins in a row on the same key it could not.
        """
        self._need_customer()
        added = [c for c in per_customer.columns if c != "customer"]
        if self._segments is None or self._broadcast_segments:
            joined = self._with_segment(self._source).join(per_customer, "customer", "left")
        else:
            joined = self._source.join(self._segments.join(per_customer, "customer", "left"), "customer")
        return self._present(joined, *added)

    @cached_property
    def first_dates(self) -> DataFrame:
        """First date of each customer; needs no segment."""
        self.require_dates()
        dated = self._source.filter(F.col("customer").isNotNull())
        return dated.groupBy("customer").agg(F.min("date").alias("first_date"))

    def _present(self, df: DataFrame, *added: str) -> DataFrame:
        kind = self.entity.kind
        columns = [
            F.col("customer").alias(kind),
            F.col("customer_segment").alias(f"{kind}_segment"),
            "sale",
        ]
        if self.has_dates:
            columns += [
                "date",
                F.year("date").alias("year"),
                F.month("date").alias("month"),
                F.dayofmonth("date").alias("day"),
                month_label(month_key(F.col("date"), self.month_format), self.month_format).alias("y_m"),
            ]
        return df.select(*columns, *added)

    def _as_measures(self, df: DataFrame) -> DataFrame:
        date = F.col("date") if self.has_dates else F.lit(None).cast("timestamp_ntz")
        keys = [c for c in ("customer", "customer_segment") if c in df.columns]
        return df.select(
            *keys,
            month_key(date, self.month_format).alias("ym"),
            "sale",
            date.alias("first_date"),
            date.alias("last_date"),
            date.isNotNull().cast("long").alias("n_dates"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        self._need_customer()
        return self._as_measures(self._with_segment(self._source))

    @property
    def activity(self) -> DataFrame:
        return self._cached if self._cached is not None else self._planned_activity

    @cached_property
    def _planned_activity(self) -> DataFrame:
        self._need_customer()
        if self._segments is None or self._broadcast_segments:
            return _reduce(self.facts, "customer", "customer_segment", "ym")
        # The segment hangs on the customer alone, so joining after the
        # reduction gives the same sums and shuffles far fewer rows.
        reduced = _reduce(self._as_measures(self._source), "customer", "ym")
        # A pair that the segment table repeats counts as often as it is there.
        return _reduce(self._with_segment(reduced), "customer", "customer_segment", "ym")

    @property
    def measures(self) -> DataFrame:
        large_segments = self._segments is not None and not self._broadcast_segments
        return self.activity if self._cached is not None or large_segments else self.facts

    def cache(self) -> "Base":
        """Keep the activity, laid out by customer, for a run of many metrics.

        Everything keyed by customer then runs without another shuffle.  Lost
        blocks are recomputed from the source.
        """
        if self._cached is None:
            by_customer = self.activity.repartition("customer")
            self._cached = by_customer.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def store(self, name: str | None = None, buckets: int | None = None) -> "Base":
        """Keep the activity as a table of the session's catalog, bucketed and sorted by customer.

        Like :meth:`cache`, but the table lies in the shared warehouse: losing
        executors loses nothing, and metrics read neither the source nor
        anything of it again.  ``unpersist`` drops the table.
        """
        if self._cached is None:
            buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._table = name or f"activity_{uuid.uuid4().hex}"
            by_customer = self.activity.repartition(buckets, "customer")
            by_customer.write.format("parquet").bucketBy(buckets, "customer").sortBy("customer").saveAsTable(self._table)
            self._cached = self.spark.table(self._table)
        return self

    def unpersist(self) -> None:
        if self._table is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self._table}`")
        elif self._cached is not None:
            self._cached.unpersist()
        self._cached = self._table = None

    def __enter__(self) -> "Base":
        return self.cache()

    def __exit__(self, *exc) -> None:
        self.unpersist()

    def _need_customer(self):
        if self.entity.kind != "customer":
            raise TypeError(f"metrics need a customer entity, this base is bound to {self.entity.kind!r}")

    def require_dates(self) -> "Base":
        self._need_customer()
        if not self.has_dates:
            raise TypeError("this metric needs a date role")
        return self


def _reduce(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(
        F.sum("sale").alias("sale"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("n_dates").alias("n_dates"),
    )


def _bytes(table: DataFrame) -> int:
    """Size of a table's values, measured rather than estimated."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in table.columns), F.lit(0))
    return table.agg(F.sum(width)).first()[0] or 0


def _key(df: DataFrame, name: str) -> Column:
    """An entity id; a NaN in a floating id column is a missing id."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return nan_to_null(F.col(name).cast("double"))
    return F.col(name)


def bind(
    df: DataFrame,
    entity: Entity,
    sale: Sale,
    dates: Dates | None = None,
    *,
    segments: SegmentTable | None = None,
    month_format: str = SHORT_MONTH,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Base:
    """Validate the roles against ``df`` and return the bound base.

    A row survives only if it passes the filter of every role.  Filters are
    put on the stored columns, so they reach the file scan.
    """
    if month_format not in MONTH_FORMATS:
        raise ValueError(f"month_format must be one of {MONTH_FORMATS}, got {month_format!r}")
    if entity.segment is not None and segments is not None:
        raise TypeError("give the segment as a column or as a table, not both")
    amount = sale.amount(df)
    columns = [_key(df, entity.column).alias("customer")]
    if dates is not None:
        date = dates.timestamp(df)
        for condition in (dates.range_filter(df), dates.part_filter(date)):
            if condition is not None:
                df = df.filter(condition)
    segment_table, small = None, False
    if segments is not None:
        table = segments.table
        if entity.keep_segments:
            table = table.filter(F.col(segments.segment).isin(entity.keep_segments))
        segment_table = table.select(
            F.col(segments.key).alias("customer"), F.col(segments.segment).alias("customer_segment")
        )
        small = _bytes(segment_table) <= broadcast_bytes
    elif entity.segment is not None:
        if entity.keep_segments:
            df = df.filter(F.col(entity.segment).isin(entity.keep_segments))
        columns.append(F.col(entity.segment).alias("customer_segment"))
    else:
        columns.append(F.lit(NO_SEGMENT).alias("customer_segment"))
    columns.append(amount.alias("sale"))
    if dates is not None:
        columns.append(date.alias("date"))
    return Base(df.select(*columns), entity, dates, month_format, segment_table, small)


def calendar_values(base: Base, part: str) -> DataFrame:
    """Sorted distinct years, months or days of the bound rows."""
    if part not in ("year", "month", "day"):
        raise ValueError(f"calendar part must be year, month or day, got {part!r}")
    return base.require_dates().rows.select(part).distinct().orderBy(part)


def row_count(base: Base) -> DataFrame:
    return base.rows.agg(F.count("*").alias("row_count"))
