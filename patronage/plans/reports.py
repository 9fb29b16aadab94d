"""One report per analysis.

``data`` holds the result frames by name and ``charts`` the tidy frames that
the usual charts are drawn from.  Both are lazy: an entry is planned when it is
looked up and computed when an action runs on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators import basic, cohort, growth, new_existing, retention, rfm
from ..operators.materialize import materialize
from ..sources import Base


class Frames(Mapping):
    """Named frames, each planned at its first lookup."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


class Report:
    def __init__(self, base: Base):
        self.base = base
        self.measures = base.measures
        self.month_format = base.month_format
        self.data = Frames(self._data())
        self.charts = Frames(self._charts())

    def _data(self) -> dict[str, Callable[[], DataFrame]]:
        raise NotImplementedError

    def _charts(self) -> dict[str, Callable[[], DataFrame]]:
        return {}

    def _show(self, *names: str) -> dict[str, Callable[[], DataFrame]]:
        return {name: (lambda name=name: self.data[name]) for name in names}


class BasicInfo(Report):
    """Revenue and customer totals.  The only report that works without dates."""

    def _data(self):
        m = self.measures
        return {
            "total_revenue": lambda: basic.total_revenue(m),
            "unique_customer": lambda: basic.unique_customer(m),
            "customer_revenue": lambda: basic.customer_revenue(m),
            "avg_customer_revenue": lambda: basic.avg_customer_revenue(m),
            "segment_revenue": lambda: basic.segment_revenue(m),
            "segment_unique_customer": lambda: basic.segment_unique_customer(m),
        }

    def _charts(self):
        return self._show("customer_revenue", "segment_revenue", "segment_unique_customer")

    @cached_property
    def totals(self) -> dict[str, float]:
        """The three scalars, from one job."""
        return basic.totals(self.measures).first().asDict()


class Growth(Report):
    def __init__(self, base: Base):
        super().__init__(base.require_dates())

    def _data(self):
        m, fmt = self.measures, self.month_format
        return {
            "monthly_revenue": lambda: growth.monthly_revenue(m, fmt),
            "monthly_customer": lambda: growth.monthly_customer(m, fmt),
            "segment_monthly_revenue": lambda: growth.segment_monthly_revenue(m, fmt),
            "segment_monthly_customer": lambda: growth.segment_monthly_customer(m, fmt),
        }

    def _charts(self):
        return self._show(*self.data)


class NewExisting(Report):
    def __init__(self, base: Base):
        super().__init__(base.require_dates())

    @cached_property
    def typed(self) -> DataFrame:
        return new_existing.typed_activity(self.measures, self.month_format)

    @cached_property
    def rows(self) -> DataFrame:
        """The bound rows with their purchase type."""
        return new_existing.typed_rows(self.base)

    def _data(self):
        fmt = self.month_format
        return {
            "count": lambda: new_existing.count(self.typed, fmt),
            "month_new_percent": lambda: new_existing.month_new_percent(self.typed, fmt),
            "type_percent": lambda: new_existing.type_percent(self.typed),
            "segment_count": lambda: new_existing.segment_count(self.typed, fmt),
            "segment_monthly_new_percent": lambda: new_existing.segment_monthly_new_percent(self.typed, fmt),
        }

    def _charts(self):
        return self._show(*self.data)


class Retention(Report):
    def __init__(self, base: Base):
        super().__init__(base.require_dates())

    def _data(self):
        m, fmt = self.measures, self.month_format
        return {
            "by_customer": lambda: retention.by_customer(m, fmt),
            "by_month": lambda: retention.by_month(m, fmt),
        }

    def _charts(self):
        return {
            "retention": lambda: retention.by_month_long(self.data["by_month"]),
            "retention_pct": lambda: self.data["by_month"].select("y_m", retention.RATE),
        }


class Cohort(Report):
    def __init__(self, base: Base):
        super().__init__(base.require_dates())

    @cached_property
    def long(self) -> DataFrame:
        """One row per cohort and index, 144 at most, feeding the four tables."""
        return materialize(cohort.cohort_long(self.measures))

    @cached_property
    def indexes(self) -> list[int]:
        return cohort.observed_indexes(self.long)

    def _data(self):
        return {
            "by_revenue": lambda: cohort.by_revenue(self.long, self.indexes),
            "by_revenue_pct": lambda: cohort.by_revenue_pct(self.long, self.indexes),
            "by_retention": lambda: cohort.by_retention(self.long, self.indexes),
            "by_retention_pct": lambda: cohort.by_retention_pct(self.long, self.indexes),
        }

    def _charts(self):
        return self._show(*self.data)


class RFMSegmentation(Report):
    """Customers by recency, frequency and monetary value.

    Looking up a segment fits the clusters, which runs jobs; the customer-level
    frame they read is materialized first.
    """

    def __init__(self, base: Base, r_clusters: int = 4, f_clusters: int = 4, m_clusters: int = 4, method: str = "lloyd"):
        self.clusters = (r_clusters, f_clusters, m_clusters)
        self.method = method
        super().__init__(base.require_dates())

    @cached_property
    def customers(self) -> DataFrame:
        """Read once from the source, and materialized."""
        return rfm.rfm(self.measures, with_revenue=True)

    @cached_property
    def segmented(self) -> DataFrame:
        """Measures, ranks, score, segment and total revenue per customer."""
        ranked = rfm.clustered(self.customers, self.clusters, self.method)
        return rfm.segmented(rfm.scored(ranked))

    def _data(self):
        return {
            "rfm": lambda: self.customers.drop(rfm.REVENUE),
            "segment": lambda: self.segmented.drop(rfm.REVENUE),
        }

    def _charts(self):
        charts = {m.lower(): (lambda m=m: self.histograms.where(F.col("measure") == m)) for m in rfm.MEASURES}
        for x, y in rfm.PAIRS:
            charts[f"{x}_{y}".lower()] = lambda x=x, y=y: self.trends.where((F.col("x") == x) & (F.col("y") == y))
        return charts

    @cached_property
    def histograms(self) -> DataFrame:
        """All bins of all measures, from one pass; at most 30 each."""
        return materialize(rfm.histograms(self.customers))

    @cached_property
    def trends(self) -> DataFrame:
        """All trend lines, from one pass; one for each pair and segment."""
        return materialize(rfm.trends(self.segmented))
