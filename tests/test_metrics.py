import math

import pytest

from patronage import BasicInfo, Cohort, Growth, NewExisting, Retention
from patronage.functions.calendar import LONG_MONTH
from patronage.operators import retention

from conftest import records

NULL_KEYS = [
    ("a", "x", 1.0, "2020-01-01"),
    (None, "x", 2.0, "2020-01-02"),
    ("b", None, 4.0, "2020-02-01"),
    ("a", "y", 8.0, None),
    (None, None, 16.0, None),
]


def test_totals_with_null_keys(grain):
    report = BasicInfo(grain(NULL_KEYS))
    assert report.totals == {"total_revenue": 31.0, "unique_customer": 2, "avg_customer_revenue": 6.5}
    assert records(report.data["total_revenue"]) == [(31.0,)]
    assert records(report.data["unique_customer"]) == [(2,)]
    assert records(report.data["avg_customer_revenue"]) == [(6.5,)]
    assert [tuple(r) for r in report.data["customer_revenue"].collect()] == [("b", 4.0), ("a", 9.0)]


def test_segment_shares_leave_out_null_segments(grain):
    report = BasicInfo(grain(NULL_KEYS))
    revenue = [tuple(r) for r in report.data["segment_revenue"].collect()]
    assert revenue == [("x", 3.0, pytest.approx(3 / 11)), ("y", 8.0, pytest.approx(8 / 11))]
    assert records(report.data["segment_unique_customer"]) == [("x", 1, 0.5), ("y", 1, 0.5)]


def test_all_null_sales_sum_to_zero(grain):
    rows = [("a", "x", None, "2020-01-01"), ("a", "x", None, "2020-01-02"), ("b", "y", float("nan"), "2020-01-03")]
    base = grain(rows)
    assert records(BasicInfo(base).data["customer_revenue"]) == [("a", 0.0), ("b", 0.0)]
    assert records(Growth(base).data["monthly_revenue"]) == [("20_01", 0.0)]
    assert records(Retention(base).data["by_month"]) == [("20_01", 0, 0, None)]
    assert BasicInfo(base).totals["avg_customer_revenue"] == 0.0


def test_zero_denominators_are_null(grain):
    base = grain([("a", "x", 5.0, "2020-01-01"), ("b", "y", -5.0, "2020-01-01"), ("a", "x", 7.0, "2020-02-01"), ("a", "y", -7.0, "2020-02-01")])
    assert records(BasicInfo(base).data["segment_revenue"], "customer_segment", "percent") == [("x", None), ("y", None)]
    pct = Cohort(base).data["by_revenue_pct"]
    assert pct.columns == ["Cohort Month", "1", "2"]
    assert records(pct) == [(1, None, None)]


def test_empty_input(grain):
    base = grain([])
    assert BasicInfo(base).totals == {"total_revenue": 0.0, "unique_customer": 0, "avg_customer_revenue": None}
    for report in (BasicInfo(base), Growth(base), NewExisting(base), Retention(base), Cohort(base)):
        for name, df in report.data.items():
            expected = 1 if name in ("total_revenue", "unique_customer", "avg_customer_revenue") else 0
            assert df.count() == expected, name


def test_multi_segment_customer_counts_in_each(grain):
    base = grain([("a", "x", 1.0, "2020-01-01"), ("a", "y", 1.0, "2020-01-01"), ("b", "y", 1.0, "2020-01-01")])
    assert records(BasicInfo(base).data["segment_unique_customer"]) == [
        ("x", 1, pytest.approx(1 / 3)),
        ("y", 2, pytest.approx(2 / 3)),
    ]


def test_growth(grain):
    data = Growth(grain(NULL_KEYS)).data
    assert [tuple(r) for r in data["monthly_revenue"].collect()] == [("20_01", 3.0), ("20_02", 4.0)]
    assert records(data["monthly_customer"]) == [("20_01", 1), ("20_02", 1)]
    assert records(data["segment_monthly_revenue"]) == [("20_01", "x", 3.0)]
    assert records(data["segment_monthly_customer"]) == [("20_01", "x", 1)]


CENTURY = [("a", "x", 1.0, "1999-12-01"), ("a", "x", 2.0, "2000-01-01")]


def test_short_month_keys_sort_as_text(grain):
    months = [r.y_m for r in Growth(grain(CENTURY)).data["monthly_revenue"].collect()]
    assert months == ["00_01", "99_12"]
    # In text order December 1999 follows January 2000, and is retained from it.
    assert [tuple(r)[:3] for r in Retention(grain(CENTURY)).data["by_month"].collect()] == [("00_01", 1, 0), ("99_12", 1, 1)]


def test_long_month_keys_sort_by_time(grain):
    base = grain(CENTURY, month_format=LONG_MONTH)
    assert [r.y_m for r in Growth(base).data["monthly_revenue"].collect()] == ["1999_12", "2000_01"]
    assert [tuple(r)[:3] for r in Retention(base).data["by_month"].collect()] == [("1999_12", 1, 0), ("2000_01", 1, 1)]


def test_short_month_keys_merge_centuries(grain):
    base = grain([("a", "x", 1.0, "1920-05-01"), ("b", "x", 2.0, "2020-05-01")])
    assert records(Growth(base).data["monthly_revenue"]) == [("20_05", 3.0)]


def test_new_then_existing(grain):
    base = grain(
        [
            ("a", "x", 1.0, "2020-01-01"),
            ("a", "x", 1.0, "2020-01-20"),
            ("a", "x", 1.0, "2020-03-01"),
            ("b", "y", 1.0, "2020-03-01"),
        ]
    )
    data = NewExisting(base).data
    assert records(data["count"]) == [("20_01", "New", 1), ("20_03", "Existing", 1), ("20_03", "New", 1)]
    assert records(data["month_new_percent"]) == [("20_01", 0, 1, 0.0), ("20_03", 1, 1, 1.0)]
    assert records(data["type_percent"]) == [("Existing", pytest.approx(1 / 3)), ("New", pytest.approx(2 / 3))]
    assert records(data["segment_count"]) == [("20_01", "New", "x", 1), ("20_03", "Existing", "x", 1), ("20_03", "New", "y", 1)]
    assert records(data["segment_monthly_new_percent"]) == [
        ("20_01", "x", 0, 1, 0.0),
        ("20_03", "x", 1, 0, 0.0),
        ("20_03", "y", 0, 1, 0.0),
    ]
    typed = records(NewExisting(base).rows, "customer", "y_m", "first_purchase", "type")
    assert typed == [
        ("a", "20_01", "20_01", "New"),
        ("a", "20_01", "20_01", "New"),
        ("a", "20_03", "20_01", "Existing"),
        ("b", "20_03", "20_03", "New"),
    ]


def test_null_customer_and_null_date_are_existing(grain):
    base = grain([("a", "x", 1.0, "2020-01-01"), ("a", "x", 1.0, None), (None, "x", 1.0, "2020-01-01"), (None, "x", 1.0, "2020-02-01")])
    data = NewExisting(base).data
    assert records(data["count"]) == [("20_01", "Existing", 0), ("20_01", "New", 1), ("20_02", "Existing", 0)]
    # New over an Existing group without known customers.
    assert records(data["month_new_percent"]) == [("20_01", 0, 1, math.inf), ("20_02", 0, 0, 0.0)]
    assert records(data["type_percent"]) == [("Existing", 0.5), ("New", 0.5)]
    types = records(NewExisting(base).rows, "customer", "date", "type")
    assert [t[2] for t in types if t[0] is None] == ["Existing", "Existing"]
    assert [t[2] for t in types if t[0] == "a" and t[1] is None] == ["Existing"]


def test_type_percent_without_known_customers(grain):
    assert records(NewExisting(grain([(None, "x", 1.0, "2020-01-01")])).data["type_percent"]) == [("Existing", 0.0)]


def test_single_month_has_no_existing(grain):
    data = NewExisting(grain([("a", "x", 1.0, "2020-01-01"), ("b", "x", 1.0, "2020-01-02")])).data
    assert records(data["month_new_percent"]) == [("20_01", 0, 2, 0.0)]
    assert records(data["type_percent"]) == [("New", 1.0)]


def test_first_purchase_follows_the_filters(make_base):
    from patronage import Dates

    rows = [("a", "x", 1.0, "2019-01-01"), ("a", "x", 1.0, "2020-05-01")]
    data = NewExisting(make_base(rows, dates=Dates("date", years=[2020]))).data
    assert records(data["count"]) == [("20_05", "New", 1)]


def test_net_negative_months_are_inactive(grain):
    base = grain(
        [
            ("a", "x", 5.0, "2020-01-01"),
            ("a", "x", -5.0, "2020-01-09"),
            ("a", "x", 3.0, "2020-02-01"),
            ("b", "x", 3.0, "2020-01-01"),
            ("b", "x", -9.0, "2020-02-01"),
        ]
    )
    data = Retention(base).data
    assert records(data["by_customer"]) == [("a", 0, 1), ("b", 1, 0)]
    assert [tuple(r) for r in data["by_month"].collect()] == [("20_01", 1, 0, 0.0), ("20_02", 1, 0, 0.0)]


def test_retention_skips_months_in_which_nobody_bought(grain):
    gap = [("a", "x", 1.0, "2020-01-01"), ("a", "x", 1.0, "2020-03-01")]
    assert [r[2] for r in Retention(grain(gap)).data["by_month"].collect()] == [0, 1]
    filled = gap + [("b", "x", 1.0, "2020-02-01")]
    assert [r[2] for r in Retention(grain(filled)).data["by_month"].collect()] == [0, 0, 0]
    # A month with only inactive customers still is an observed month.
    inactive = gap + [("b", "x", -1.0, "2020-02-01")]
    assert [tuple(r) for r in Retention(grain(inactive)).data["by_month"].collect()] == [
        ("20_01", 1, 0, 0.0),
        ("20_02", 0, 0, None),
        ("20_03", 1, 0, 0.0),
    ]


def test_retention_long_form(grain):
    report = Retention(grain([("a", "x", 1.0, "2020-01-01"), ("a", "x", 1.0, "2020-02-01")]))
    assert records(report.charts["retention"]) == [
        ("20_01", "Retained customer", 0),
        ("20_01", "Total unique customer", 1),
        ("20_02", "Retained customer", 1),
        ("20_02", "Total unique customer", 1),
    ]
    assert records(report.charts["retention_pct"]) == [("20_01", 0.0), ("20_02", 1.0)]


def test_by_customer_with_given_months(make_base):
    m = make_base([("a", "x", 1.0, "2020-01-01")]).measures
    assert records(retention.by_customer(m, months=["20_01", "20_02"])) == [("a", 1, 0)]


def test_cohorts_ignore_the_year(grain):
    base = grain(
        [
            ("a", "x", 5.0, "2020-12-01"),
            ("a", "x", 10.0, "2021-01-01"),
            ("b", "x", 2.0, "2020-12-01"),
            (None, "x", 9.0, "2020-12-01"),
            ("a", "x", 9.0, None),
        ]
    )
    data = Cohort(base).data
    assert data["by_revenue"].columns == ["Cohort Month", "1", "12"]
    assert records(data["by_revenue"]) == [(1, 10.0, 5.0), (12, 2.0, None)]
    assert records(data["by_revenue_pct"]) == [(1, 1.0, 0.5), (12, 1.0, None)]
    assert records(data["by_retention"]) == [(1, 1, 1), (12, 1, None)]
    assert records(data["by_retention_pct"]) == [(1, 1.0, 1.0), (12, 1.0, None)]
