"""Role declarations: which columns are the entity, the sale and the date.

A role only names columns and filters.  Nothing is read until :func:`bind`
puts the roles on one DataFrame, whose rows are aligned by construction.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.calendar import pivot_two_digit_year, spark_pattern
from ..functions.nulls import nan_to_null

# Entity kinds, the segment given to unsegmented entities, and
# the date format assumed for text dates.
ENTITY_KINDS = ("customer", "product", "area")
NO_SEGMENT = "no segment"
DEFAULT_DATE_FORMAT = "%m-%d-%Y"


@dataclass(frozen=True)
class Entity:
    """The entity id, optionally with a segment and the segments to keep."""

    column: str
    segment: str | None = None
    keep_segments: list = field(default_factory=list)
    kind: str = "customer"

    def __post_init__(self):
        if self.kind not in ENTITY_KINDS:
            raise TypeError(f"entity kind must be one of {ENTITY_KINDS}, got {self.kind!r}")


@dataclass(frozen=True)
class Sale:
    """The sale amount; any numeric column."""

    column: str

    def amount(self, df: DataFrame) -> Column:
        dtype = df.schema[self.column].dataType
        if not isinstance(dtype, T.NumericType):
            raise TypeError(f"sale column {self.column!r} must be numeric, got {dtype.simpleString()}")
        value = F.col(self.column).cast("double")
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            value = nan_to_null(value)
        return value


@dataclass(frozen=True)
class Dates:
    """The date, its text format, and the calendar parts to keep.

    Text that does not parse raises an error when the first metric runs,
    whatever the session's ANSI setting.  With ``validate`` a text column is
    scanned once at bind time, and the error is a ValueError raised there.
    """

    column: str
    format: str = DEFAULT_DATE_FORMAT
    years: list = field(default_factory=list)
    months: list = field(default_factory=list)
    days: list = field(default_factory=list)
    validate: bool = False

    def __post_init__(self):
        for name in ("years", "months", "days"):
            value = getattr(self, name)
            if not isinstance(value, list):
                raise TypeError(f"{name} must be a list, got {type(value).__name__}")

    def timestamp(self, df: DataFrame) -> Column:
        dtype = df.schema[self.column].dataType
        col = F.col(self.column)
        if isinstance(dtype, T.TimestampNTZType):
            return col
        if isinstance(dtype, (T.TimestampType, T.DateType)):
            return col.cast("timestamp_ntz")
        if not isinstance(dtype, T.StringType):
            raise ValueError(f"cannot read {dtype.simpleString()} column {self.column!r} as dates")
        pattern = spark_pattern(self.format)
        if self.validate:
            bad = col.isNotNull() & F.try_to_timestamp(col, F.lit(pattern)).isNull()
            if not df.select(self.column).filter(bad).isEmpty():
                raise ValueError(f"column {self.column!r} has dates not in format {self.format!r}")
        message = F.concat(F.lit(f"column {self.column!r} has a date not in format {self.format!r}: "), col)
        read = F.try_to_timestamp(col, F.lit(pattern)).cast("timestamp_ntz")
        parsed = F.when(col.isNotNull() & read.isNull(), F.raise_error(message).cast("timestamp_ntz")).otherwise(read)
        return pivot_two_digit_year(parsed) if "%y" in self.format else parsed

    def part_filter(self, date: Column) -> Column | None:
        """Conjunction of the calendar-part lists; None when none was given.

        Without lists rows with a null date stay; any list drops them.
        """
        parts = ((F.year, self.years), (F.month, self.months), (F.dayofmonth, self.days))
        terms = [part(date).isin(values) for part, values in parts if values]
        return reduce(lambda a, b: a & b, terms) if terms else None

    def range_filter(self, df: DataFrame) -> Column | None:
        """Year list as plain ranges on the stored column.

        It is implied by :meth:`part_filter`; a file scan can skip row groups
        by it, which it cannot by a year() call.
        """
        dtype = df.schema[self.column].dataType
        if not self.years or not isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            return None
        col = F.col(self.column)

        def start(year):
            return F.lit(datetime(year, 1, 1).isoformat(sep=" ")).cast(dtype)

        spans = []
        for year in sorted({int(y) for y in self.years}):
            if spans and spans[-1][1] == year:
                spans[-1][1] = year + 1
            else:
                spans.append([year, year + 1])
        if spans[0][0] < 1 or spans[-1][1] > 9999:
            return None
        return reduce(
            lambda a, b: a | b,
            [(col >= start(first)) & (col < start(after)) for first, after in spans],
        )
