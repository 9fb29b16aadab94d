import pytest
from pyspark.sql import functions as F

from patronage import BasicInfo, Cohort, Dates, Entity, Growth, Sale, bind
from patronage.functions.calendar import LONG_MONTH, spark_pattern
from patronage.sources.binding import calendar_values, row_count

from conftest import day, frame, records, segment_table_base

ROWS = [
    ("a", "x", 10.0, "2020-01-05"),
    ("a", "x", 20.0, "2021-02-06"),
    ("b", "y", 30.0, "2020-02-07"),
    ("c", None, 40.0, "2020-03-08"),
    ("d", "z", 50.0, None),
]


def test_rows_have_calendar_parts(make_base):
    rows = make_base(ROWS[:1]).rows
    assert rows.columns == ["customer", "customer_segment", "sale", "date", "year", "month", "day", "y_m"]
    assert tuple(rows.first()) == ("a", "x", 10.0, day("2020-01-05"), 2020, 1, 5, "20_01")


def test_null_date_has_null_parts(make_base):
    row = make_base(ROWS[4:]).rows.first()
    assert (row.date, row.year, row.month, row.day, row.y_m) == (None,) * 5


def test_long_month_format(make_base):
    assert make_base(ROWS[:1], month_format=LONG_MONTH).rows.first().y_m == "2020_01"
    with pytest.raises(ValueError):
        make_base(ROWS, month_format="MM_yy")


def test_no_segment_list_keeps_null_segments_and_a_list_drops_them(make_base):
    assert make_base(ROWS).rows.count() == 5
    kept = make_base(ROWS, keep_segments=["x", "z"]).rows
    assert records(kept, "customer") == [("a",), ("a",), ("d",)]


def test_missing_segment_column_gives_a_constant(spark):
    base = bind(frame(spark, ROWS), Entity("customer"), Sale("sale"), Dates("date"))
    assert {r.customer_segment for r in base.rows.collect()} == {"no segment"}


def test_calendar_lists_conjoin_and_drop_null_dates(make_base):
    assert make_base(ROWS).rows.count() == 5
    assert records(make_base(ROWS, dates=Dates("date", years=[2020])).rows, "customer") == [("a",), ("b",), ("c",)]
    both = make_base(ROWS, dates=Dates("date", years=[2020], months=[2, 3], days=[8]))
    assert records(both.rows, "customer") == [("c",)]


def test_filters_of_all_roles_conjoin(make_base):
    base = make_base(ROWS, keep_segments=["x"], dates=Dates("date", years=[2020]))
    assert records(base.rows, "customer", "sale") == [("a", 10.0)]


def test_calendar_values_and_row_count(make_base):
    base = make_base(ROWS)
    assert [r[0] for r in calendar_values(base, "year").collect()] == [None, 2020, 2021]
    assert [r[0] for r in calendar_values(base, "month").collect()] == [None, 1, 2, 3]
    assert row_count(base).first()[0] == 5
    with pytest.raises(ValueError):
        calendar_values(base, "hour")


def test_nan_sale_is_missing(make_base):
    base = make_base([("a", "x", float("nan"), "2020-01-01"), ("a", "x", 2.0, "2020-01-01")])
    assert BasicInfo(base).totals["total_revenue"] == 2.0


def test_nan_customer_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (1.0, 2.0)], "id double, sale double")
    base = bind(df, Entity("id"), Sale("sale"))
    assert BasicInfo(base).totals == {"total_revenue": 3.0, "unique_customer": 1, "avg_customer_revenue": 2.0}


def test_integer_and_decimal_sales_become_double(spark):
    for kind in ("int", "bigint", "decimal(10,2)", "float"):
        df = spark.range(1).select(F.lit("a").alias("c"), F.lit(3).cast(kind).alias("s"))
        assert bind(df, Entity("c"), Sale("s")).rows.first().sale == 3.0


@pytest.mark.parametrize("kind", ["string", "boolean", "date"])
def test_non_numeric_sale_is_refused(spark, kind):
    df = spark.range(1).select(F.lit("a").alias("c"), F.lit(None).cast(kind).alias("s"))
    with pytest.raises(TypeError):
        bind(df, Entity("c"), Sale("s"))


def test_entity_kind_is_checked():
    with pytest.raises(TypeError):
        Entity("customer", kind="shop")


def test_other_entities_bind_but_have_no_metrics(spark):
    df = frame(spark, ROWS)
    for kind in ("product", "area"):
        base = bind(df, Entity("customer", segment="segment", kind=kind), Sale("sale"), Dates("date"))
        assert base.rows.columns[:2] == [kind, f"{kind}_segment"]
        for report in (BasicInfo, Growth, Cohort):
            with pytest.raises(TypeError):
                report(base)


def test_only_basic_info_works_without_dates(spark):
    base = bind(frame(spark, ROWS), Entity("customer", segment="segment"), Sale("sale"))
    assert base.rows.columns == ["customer", "customer_segment", "sale"]
    assert BasicInfo(base).totals["total_revenue"] == 150.0
    with pytest.raises(TypeError):
        Growth(base)


@pytest.mark.parametrize("part", ["years", "months", "days"])
def test_calendar_part_must_be_a_list(part):
    with pytest.raises(TypeError):
        Dates("date", **{part: 2020})


def text_base(spark, texts, fmt, **options):
    df = spark.createDataFrame([(t, 1.0) for t in texts], "t string, sale double")
    return bind(df.withColumn("c", F.lit("a")), Entity("c"), Sale("sale"), Dates("t", fmt, **options))


@pytest.mark.parametrize(
    "fmt, text, expected",
    [
        ("%m-%d-%Y", "1-2-2020", "2020-01-02"),
        ("%m-%d-%Y", "01-02-2020", "2020-01-02"),
        ("%d/%m/%Y", "31/12/1999", "1999-12-31"),
        ("%Y%m%d", "20200305", "2020-03-05"),
        ("%d.%m.%y", "1.2.70", "1970-02-01"),
        ("%d.%m.%y", "1.2.69", "1969-02-01"),
        ("%d.%m.%y", "1.2.68", "2068-02-01"),
        ("%y%m%d", "991231", "1999-12-31"),
        ("%Y-%m-%dT%H:%M:%S", "2020-03-05T07:08:09", "2020-03-05 07:08:09"),
        ("%Y-%m-%d %H:%M:%S.%f", "2020-03-05 07:08:09.25", "2020-03-05 07:08:09.250"),
        ("%d %b %Y", "5 Mar 2020", "2020-03-05"),
        ("%I:%M %p on %d %B %Y", "07:30 PM on 05 March 2020", "2020-03-05 19:30"),
    ],
)
def test_text_dates(spark, fmt, text, expected):
    assert text_base(spark, [text], fmt).rows.first().date == day(expected)


def test_bad_text_date_is_refused_at_bind_time_if_asked(spark):
    with pytest.raises(ValueError):
        text_base(spark, ["01-02-2020", "xx"], "%m-%d-%Y", validate=True)
    assert text_base(spark, ["01-02-2020", None], "%m-%d-%Y", validate=True).rows.count() == 2


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_text_date_fails_when_used(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="has a date not in format"):
            text_base(spark, ["xx"], "%m-%d-%Y").rows.collect()
        assert text_base(spark, ["01-02-2020", None], "%m-%d-%Y").rows.count() == 2
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_repeated_segment_pair_gives_one_activity_row_in_both_joins(spark):
    facts = [("a", 1.0, "2020-01-01"), ("a", 2.0, "2020-01-09")]
    for broadcast_bytes in (0, 1 << 20):
        base = segment_table_base(spark, facts, [("a", "x"), ("a", "x")], broadcast_bytes)
        assert records(base.activity, "customer", "customer_segment", "sale", "n_dates") == [("a", "x", 6.0, 4)]


def test_unknown_directive_is_refused():
    with pytest.raises(ValueError):
        spark_pattern("%Y-%Q")
    assert spark_pattern("%d%%%m") == "d'%'M"
    assert spark_pattern("%d o'clock %H") == "d' o''clock 'H"


def test_date_and_zoned_columns_are_accepted(spark):
    for kind in ("date", "timestamp"):
        df = spark.range(1).select(F.lit("a").alias("c"), F.lit(1.0).alias("s"), F.lit("2020-02-03").cast(kind).alias("d"))
        assert bind(df, Entity("c"), Sale("s"), Dates("d")).rows.first().y_m == "20_02"
        assert bind(df, Entity("c"), Sale("s"), Dates("d", years=[2020, 2021])).rows.count() == 1
        assert bind(df, Entity("c"), Sale("s"), Dates("d", years=[2019, 2021])).rows.count() == 0
    with pytest.raises(ValueError):
        bind(df.withColumn("d", F.lit(5)), Entity("c"), Sale("s"), Dates("d"))


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_segment_table_equals_segment_column(spark, make_base, broadcast_bytes):
    facts = [(c, v, d) for c, _, v, d in ROWS]
    base = segment_table_base(spark, facts, [("a", "x"), ("b", "y"), ("c", None), ("d", "z")], broadcast_bytes)
    same = make_base(ROWS)
    assert records(base.rows) == records(same.rows)
    columns = same.activity.columns
    assert records(base.activity, *columns) == records(same.activity, *columns)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_segment_table_drops_unknown_customers_and_repeats_double_ones(spark, broadcast_bytes):
    facts = [("a", 1.0, "2020-01-01"), ("b", 2.0, "2020-01-01"), (None, 4.0, "2020-01-01")]
    base = segment_table_base(spark, facts, [("a", "x"), ("a", "y")], broadcast_bytes)
    assert records(base.activity, "customer", "customer_segment", "sale") == [("a", "x", 1.0), ("a", "y", 1.0)]
    assert records(base.measures, "customer", "customer_segment", "sale") == [("a", "x", 1.0), ("a", "y", 1.0)]


def test_segment_column_and_table_exclude_each_other(spark):
    from patronage import SegmentTable

    df = frame(spark, ROWS)
    with pytest.raises(TypeError):
        bind(df, Entity("customer", segment="segment"), Sale("sale"), segments=SegmentTable(df, "customer", "segment"))
