import pytest
from pyspark.sql import functions as F

from patronage import RFMSegmentation
from patronage.operators import rfm

from conftest import records


def test_part_days_do_not_count(grain):
    base = grain([("a", "x", 1.0, "2020-01-01 23:00"), ("b", "x", 1.0, "2020-01-02 01:00"), ("c", "x", 1.0, "2020-01-01 01:00")])
    assert records(rfm.rfm(base.measures), "customer", "Recency") == [("a", 0.0), ("b", 0.0), ("c", 1.0)]


def test_measures_over_months(grain):
    base = grain(
        [
            ("a", "x", 1.0, "2020-01-01"),
            ("a", "x", 2.0, "2020-01-01"),
            ("a", "x", 4.0, None),
            ("b", "x", None, "2020-02-10"),
            (None, "x", 9.0, "2020-05-01"),
        ]
    )
    # Three months, of which one has only purchases without a customer.
    got = records(rfm.rfm(base.measures), "customer", "Recency", "Frequency", "Monetary")
    assert got == [("a", pytest.approx(40 / 3), pytest.approx(2 / 3), pytest.approx(7 / 3)), ("b", 0.0, pytest.approx(1 / 3), 0.0)]


def test_no_dates_leave_recency_null(grain):
    base = grain([("a", "x", 1.0, "2020-01-01"), ("b", "x", 2.0, None)])
    assert records(rfm.rfm(base.measures), "customer", "Recency", "Frequency") == [("a", 0.0, 1.0), ("b", None, 0.0)]


def spread(n=24):
    """Customers 0..n-1: the higher, the more recent, frequent and valuable."""
    return [
        (f"c{i:02d}", "x" if i % 3 else "y", 10.0 * (i + 1), f"2020-{1 + i // 3:02d}-{1 + j:02d}")
        for i in range(n)
        for j in range(1 + i // 4)
    ]


def test_segment_frame(make_base):
    report = RFMSegmentation(make_base(spread()))
    segment = report.data["segment"]
    assert segment.columns == [
        "customer", "MaxPurchaseDate", "Recency", "Frequency", "Monetary",
        "Recency cluster", "Frequency cluster", "Monetary cluster", "RFM Overall Score", "RFM Segment",
    ]
    rows = segment.orderBy("customer").collect()
    assert len(rows) == 24
    assert {r["RFM Segment"] for r in rows} == {"Low Value", "Mid Value", "High Value"}
    assert rows[0]["RFM Segment"] == "Low Value" and rows[-1]["RFM Segment"] == "High Value"
    for r in rows:
        assert r["RFM Overall Score"] == sum(r[c] for c in rfm.CLUSTERS) <= 9
    # Ranks grow with value, and with recent purchases.
    for measure, cluster, sign in zip(rfm.MEASURES, rfm.CLUSTERS, (-1, 1, 1)):
        ordered = sorted(rows, key=lambda r: sign * r[measure])
        ranks = [r[cluster] for r in ordered]
        assert ranks == sorted(ranks) and set(ranks) == {0, 1, 2, 3}


def test_cluster_counts_and_methods(make_base):
    base = make_base(spread())
    small = RFMSegmentation(base, 2, 3, 2).segmented
    assert small.agg(F.max("Frequency cluster")).first()[0] == 2
    assert small.agg(F.max("Recency cluster")).first()[0] == 1
    other = rfm.clustered(RFMSegmentation(base).customers, (2, 2, 2), method="mllib", n_init=2)
    assert {r[0] for r in other.select("Monetary cluster").collect()} == {0, 1}
    with pytest.raises(ValueError):
        rfm.clustered(other, method="other")


def test_row_order_does_not_matter(make_base):
    rows = spread()
    a = RFMSegmentation(make_base(rows)).data["segment"]
    b = RFMSegmentation(make_base(rows[::-1])).data["segment"]
    assert records(a) == records(b)


@pytest.mark.parametrize(
    "scores, expected",
    [
        ([0, 1, 2], ["Low Value", "High Value", "High Value"]),
        ([0, 1, 2, 3], ["Low Value", "Low Value", "Mid Value", "High Value"]),
        ([0, 3, 4, 6, 7, 9], ["Low Value", "Low Value", "Mid Value", "Mid Value", "High Value", "High Value"]),
        ([2, 4, 5, 8], ["Low Value", "Mid Value", "High Value", "High Value"]),
    ],
)
def test_segment_thresholds(spark, scores, expected):
    frame = spark.createDataFrame([(s,) for s in scores], f"`{rfm.SCORE}` long")
    assert [r[1] for r in rfm.segmented(frame).orderBy(rfm.SCORE).collect()] == expected


def test_recency_is_by_the_wall_clock_in_any_zone(spark, make_base):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        base = make_base([("a", "x", 1.0, "2020-03-08 02:30"), ("b", "x", 1.0, "2020-03-09 02:45"), ("c", "x", 1.0, "2020-03-07 03:00")])
        got = records(rfm.rfm(base.measures), "customer", "Recency")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [("a", 1.0), ("b", 0.0), ("c", 1.0)]


def test_rank_clusters(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 3.0), ("q", 9.0), ("r", 0.0), ("s", 9.0), (None, 5.0)], "c string, v double")
    up = records(rfm.rank_clusters(df, "c", "v"), "v", "c")
    # q and s tie and are ordered by label.
    assert up == [(0.0, 0), (1.0, 1), (3.0, 1), (5.0, None), (9.0, 2), (9.0, 3)]
    down = dict(records(rfm.rank_clusters(df, "c", "v", descending=True).filter("v < 9"), "v", "c"))
    assert down == {0.0: 3, 1.0: 2, 3.0: 2, 5.0: None}


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 4, 5, 10, 10)], "Recency double")
    got = records(rfm.histogram(df, "Recency", bins=2))
    assert got == [("Recency", 1, 0.0, 5.0, 3), ("Recency", 2, 5.0, 10.0, 3)]
    constant = spark.createDataFrame([(7.0,), (7.0,), (None,)], "Recency double")
    assert records(rfm.histogram(constant, "Recency", bins=3)) == [("Recency", 1, 7.0, 7.0, 2)]


def test_trend(spark):
    df = spark.createDataFrame(
        [("Low Value", 0.0, 1.0), ("Low Value", 1.0, 3.0), ("Low Value", 2.0, 5.0), ("High Value", 4.0, 4.0)],
        f"`{rfm.SEGMENT}` string, Recency double, Monetary double",
    )
    got = records(rfm.trend(df, "Recency", "Monetary"))
    assert got == [
        ("Recency", "Monetary", "High Value", None, None, None, 1),
        ("Recency", "Monetary", "Low Value", 2.0, 1.0, 1.0, 3),
    ]


def test_charts(make_base):
    charts = RFMSegmentation(make_base(spread())).charts
    assert set(charts) == {"recency", "frequency", "monetary", "recency_frequency", "recency_monetary", "frequency_monetary"}
    assert charts["monetary"].agg(F.sum("count")).first()[0] == 24
    assert charts["recency_monetary"].count() == 3
