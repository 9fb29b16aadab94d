"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Sums are rounded to cents, other results to six digits, and counts are cast to
bigint, so that results can be compared between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.calendar import LONG_MONTH
from ..operators import basic, cohort, growth, ltv, new_existing, retention, rfm
from ..operators.materialize import materialize
from ..operators.models import DEFAULT_GRIDS, search
from ..operators.nearest import NearestNeighbors
from ..sources import Dates, Entity, Sale, bind
from ..sources.binding import calendar_values, row_count
from .bindings import events_base, lineitem_base, orders_base, table
from .predictor import LifetimeValuePredictor
from .reports import RFMSegmentation
from .suite import FullAnalysis

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the filter examples, shared with the SQL they are checked by.
KEEP_SEGMENTS = ["BUILDING", "MACHINERY"]
YEARS, MONTHS, DAYS = [1996, 1997, 1999], [1, 2, 3, 11], list(range(1, 21))

# Grids of the registered searches, over five folds.  Each point is one of the
# default grid; the support-vector machine searches its linear points, forest,
# boosting and perceptron only their first.
SEARCH_GRIDS = {
    **{name: DEFAULT_GRIDS[name] for name in ("logistic_regression", "knn", "naive_bayes", "decision_tree")},
    "svc": [point for point in DEFAULT_GRIDS["svc"] if point["kernel"] == "linear"],
    **{name: DEFAULT_GRIDS[name][:1] for name in ("random_forest", "boosted_trees", "mlp")},
}


def comparable(df: DataFrame, **digits: int) -> DataFrame:
    """Round doubles (six digits unless given) and widen integers."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            col = F.round(col, digits.get(field.name, 6))
        elif isinstance(field.dataType, T.IntegralType):
            col = col.cast("long")
        columns.append(col.alias(field.name))
    return df.select(*columns)


# Binding


def bind_rows(spark, sf):
    return comparable(orders_base(spark, sf).rows)


def bind_segment_filter(spark, sf):
    return comparable(orders_base(spark, sf, keep_segments=KEEP_SEGMENTS).rows)


def bind_inline_segment_filter(spark, sf):
    entity = Entity("user_id", segment="event_type", keep_segments=["purchase", "click"])
    return comparable(bind(table(spark, sf, "events"), entity, Sale("value"), Dates("ts")).rows)


def bind_no_segment(spark, sf):
    return comparable(bind(table(spark, sf, "orders"), Entity("o_custkey"), Sale("o_totalprice"), Dates("o_orderdate")).rows)


def bind_without_date(spark, sf):
    entity = Entity("o_custkey", segment="o_orderpriority")
    return comparable(bind(table(spark, sf, "orders"), entity, Sale("o_totalprice")).rows)


def bind_calendar_filter(spark, sf):
    dates = Dates("o_orderdate", years=YEARS, months=MONTHS, days=DAYS)
    return comparable(orders_base(spark, sf, dates=dates).rows)


def bind_all_filters(spark, sf):
    dates = Dates("o_orderdate", years=YEARS, months=MONTHS, days=DAYS)
    return comparable(orders_base(spark, sf, keep_segments=KEEP_SEGMENTS, dates=dates).rows)


def bind_text_dates(spark, sf):
    texts = table(spark, sf, "orders").withColumn("text_date", F.date_format("o_orderdate", "d/M/yyyy"))
    base = bind(texts, Entity("o_custkey"), Sale("o_totalprice"), Dates("text_date", "%d/%m/%Y"))
    return comparable(base.rows)


def bind_text_short_years(spark, sf):
    texts = table(spark, sf, "orders").withColumn("text_date", F.date_format("o_orderdate", "yyMMdd"))
    base = bind(texts, Entity("o_custkey"), Sale("o_totalprice"), Dates("text_date", "%y%m%d"))
    return comparable(base.rows)


def bind_integer_sale(spark, sf):
    items = table(spark, sf, "lineitem")
    base = bind(items, Entity("l_orderkey", segment="l_returnflag"), Sale("l_linenumber"), Dates("l_shipdate"))
    return comparable(base.rows)


def bind_calendar_years(spark, sf):
    return comparable(calendar_values(orders_base(spark, sf), "year"))


def bind_calendar_months(spark, sf):
    return comparable(calendar_values(orders_base(spark, sf), "month"))


def bind_calendar_days(spark, sf):
    return comparable(calendar_values(orders_base(spark, sf), "day"))


def bind_row_count(spark, sf):
    return comparable(row_count(orders_base(spark, sf)))


def bind_activity(spark, sf):
    return comparable(orders_base(spark, sf).activity, sale=2)


# Basic info


def basic_total_revenue(spark, sf):
    return comparable(basic.total_revenue(orders_base(spark, sf).measures), total_revenue=2)


def basic_unique_customer(spark, sf):
    return comparable(basic.unique_customer(orders_base(spark, sf).measures))


def basic_customer_revenue(spark, sf):
    return comparable(basic.customer_revenue(orders_base(spark, sf).measures), sale=2)


def basic_avg_customer_revenue(spark, sf):
    return comparable(basic.avg_customer_revenue(orders_base(spark, sf).measures), avg_customer_revenue=4)


def basic_segment_revenue(spark, sf):
    return comparable(basic.segment_revenue(orders_base(spark, sf).measures), sale=2)


def basic_segment_unique_customer(spark, sf):
    return comparable(basic.segment_unique_customer(orders_base(spark, sf).measures))


def basic_totals_without_date(spark, sf):
    base = bind(table(spark, sf, "orders"), Entity("o_custkey", segment="o_orderpriority"), Sale("o_totalprice"))
    return comparable(basic.totals(base.measures), total_revenue=2, avg_customer_revenue=4)


def basic_segment_unique_customer_events(spark, sf):
    return comparable(basic.segment_unique_customer(events_base(spark, sf).measures))


def basic_totals_filtered(spark, sf):
    dates = Dates("o_orderdate", years=YEARS, months=MONTHS, days=DAYS)
    base = orders_base(spark, sf, keep_segments=KEEP_SEGMENTS, dates=dates)
    return comparable(basic.totals(base.measures), total_revenue=2, avg_customer_revenue=4)


# Growth


def growth_monthly_revenue(spark, sf):
    return comparable(growth.monthly_revenue(orders_base(spark, sf).measures), sale=2)


def growth_monthly_customer(spark, sf):
    return comparable(growth.monthly_customer(orders_base(spark, sf).measures))


def growth_segment_monthly_revenue(spark, sf):
    return comparable(growth.segment_monthly_revenue(orders_base(spark, sf).measures), sale=2)


def growth_segment_monthly_customer(spark, sf):
    return comparable(growth.segment_monthly_customer(orders_base(spark, sf).measures))


def growth_monthly_revenue_lineitem(spark, sf):
    return comparable(growth.monthly_revenue(lineitem_base(spark, sf).measures), sale=2)


# New and existing customers


def _typed(base):
    return new_existing.typed_activity(base.measures, base.month_format)


def new_existing_rows(spark, sf):
    return comparable(new_existing.typed_rows(orders_base(spark, sf)))


def new_existing_count(spark, sf):
    return comparable(new_existing.count(_typed(orders_base(spark, sf))))


def new_existing_month_new_percent(spark, sf):
    return comparable(new_existing.month_new_percent(_typed(orders_base(spark, sf))))


def new_existing_type_percent(spark, sf):
    return comparable(new_existing.type_percent(_typed(orders_base(spark, sf))))


def new_existing_segment_count(spark, sf):
    return comparable(new_existing.segment_count(_typed(orders_base(spark, sf))))


def new_existing_segment_monthly_new_percent(spark, sf):
    return comparable(new_existing.segment_monthly_new_percent(_typed(orders_base(spark, sf))))


def new_existing_month_new_percent_events(spark, sf):
    return comparable(new_existing.month_new_percent(_typed(events_base(spark, sf))))


def new_existing_type_percent_filtered(spark, sf):
    dates = Dates("o_orderdate", years=YEARS)
    return comparable(new_existing.type_percent(_typed(orders_base(spark, sf, KEEP_SEGMENTS, dates))))


# Retention


def retention_activity(spark, sf):
    base = orders_base(spark, sf)
    long = retention.activity_long(base.measures)
    return comparable(growth.labelled(long, base.month_format))


def retention_by_customer(spark, sf):
    return comparable(retention.by_customer(orders_base(spark, sf).measures))


def retention_by_month(spark, sf):
    return comparable(retention.by_month(orders_base(spark, sf).measures))


def retention_by_month_long(spark, sf):
    return comparable(retention.by_month_long(retention.by_month(orders_base(spark, sf).measures)))


def retention_by_month_chronological(spark, sf):
    base = orders_base(spark, sf, month_format=LONG_MONTH)
    return comparable(retention.by_month(base.measures, base.month_format))


def retention_by_month_filtered(spark, sf):
    dates = Dates("o_orderdate", years=YEARS, months=MONTHS)
    return comparable(retention.by_month(orders_base(spark, sf, KEEP_SEGMENTS, dates).measures))


# Cohorts


def cohort_cells(spark, sf):
    return comparable(cohort.cohort_long(orders_base(spark, sf).measures), revenue=2)


def _cohort_table(spark, sf, make, digits):
    table = make(cohort.cohort_long(orders_base(spark, sf).measures))
    cells = [F.col(f"`{i}`").cast("double").alias(f"index_{i}") for i in cohort.INDEXES]
    renamed = table.select(cohort.COHORT, *cells)
    return comparable(renamed, **{f"index_{i}": digits for i in cohort.INDEXES})


def cohort_by_revenue(spark, sf):
    return _cohort_table(spark, sf, cohort.by_revenue, 2)


def cohort_by_revenue_pct(spark, sf):
    return _cohort_table(spark, sf, cohort.by_revenue_pct, 6)


def cohort_by_retention(spark, sf):
    return _cohort_table(spark, sf, cohort.by_retention, 6)


def cohort_by_retention_pct(spark, sf):
    return _cohort_table(spark, sf, cohort.by_retention_pct, 6)


# Recency, frequency, monetary value


def rfm_measures(spark, sf):
    return comparable(rfm.rfm(orders_base(spark, sf).measures))


def rfm_measures_lineitem(spark, sf):
    return comparable(rfm.rfm(lineitem_base(spark, sf).measures))


def rfm_measures_events(spark, sf):
    return comparable(rfm.rfm(events_base(spark, sf).measures))


def _segmented(spark, sf):
    return RFMSegmentation(orders_base(spark, sf)).segmented


def rfm_clusters(spark, sf):
    return comparable(_segmented(spark, sf).select("customer", *rfm.CLUSTERS))


def rfm_segment(spark, sf):
    return comparable(_segmented(spark, sf).drop(rfm.REVENUE))


def rfm_segment_sizes(spark, sf):
    """Score and segment of the customers, counted."""
    sizes = _segmented(spark, sf).groupBy(rfm.SCORE, rfm.SEGMENT).agg(F.count("*").alias("customers"))
    return comparable(sizes)


def rfm_rank_clusters(spark, sf):
    """Order priorities stand in for cluster labels."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ranked = rfm.rank_clusters(orders, "o_orderpriority", "o_totalprice", descending=True)
    return comparable(ranked.select("o_orderkey", F.col("o_orderpriority").alias("cluster")))


def _histogram(spark, sf, measure):
    return rfm.histogram(RFMSegmentation(orders_base(spark, sf)).customers, measure)


def rfm_histogram_recency(spark, sf):
    return comparable(_histogram(spark, sf, "Recency"))


def rfm_histogram_frequency(spark, sf):
    return comparable(_histogram(spark, sf, "Frequency"))


def rfm_histogram_monetary(spark, sf):
    return comparable(_histogram(spark, sf, "Monetary"), bin_start=2, bin_end=2)


def rfm_histograms(spark, sf):
    """The bins of all three measures, from one read of the source."""
    frame = RFMSegmentation(orders_base(spark, sf)).histograms
    return comparable(frame, bin_start=2, bin_end=2)


def rfm_trends(spark, sf):
    """The three trend lines per segment, from one aggregation."""
    return comparable(rfm.trends(_segmented(spark, sf)), slope=4, intercept=4)


# Lifetime value


def ltv_feature_frame(spark, sf):
    base = orders_base(spark, sf)
    frame = LifetimeValuePredictor(RFMSegmentation(base)).frame
    return comparable(frame, **{rfm.REVENUE: 2})


def ltv_feature_rows_events(spark, sf):
    """Users of several event types have a row for each."""
    m = events_base(spark, sf).measures
    frame = ltv.feature_frame(rfm.rfm(m, with_revenue=True), m)
    return comparable(frame.select("customer", "customer_segment", rfm.REVENUE), **{rfm.REVENUE: 2})


def _revenue(spark, sf):
    return materialize(rfm.customers(orders_base(spark, sf).measures).select("customer", rfm.REVENUE))


def ltv_cluster_hint(spark, sf):
    return comparable(ltv.cluster_hint(_revenue(spark, sf)).withColumn("sse", F.round(F.col("sse") / 1e9, 3)))


def ltv_trim_highest(spark, sf):
    return comparable(ltv.trim_outliers(_revenue(spark, sf), 1), **{rfm.REVENUE: 2})


def ltv_trim_quantile(spark, sf):
    return comparable(ltv.trim_outliers(_revenue(spark, sf), 0.95), **{rfm.REVENUE: 2})


def _ltv_clusters(spark, sf):
    return ltv.with_ltv_cluster(ltv.trim_outliers(_revenue(spark, sf), 1))


def ltv_clusters(spark, sf):
    return comparable(_ltv_clusters(spark, sf), **{rfm.REVENUE: 2})


def ltv_cluster_info(spark, sf):
    return comparable(ltv.ltv_cluster_info(_ltv_clusters(spark, sf)), **{"Life Time Value (Revenue)": 4})


def _training_data(spark, sf, cv):
    return LifetimeValuePredictor(RFMSegmentation(orders_base(spark, sf))).training_data(cv=cv)


def ltv_features(spark, sf):
    """Imputed, scaled and encoded features of the trimmed customers, one column each."""
    data, shape = _training_data(spark, sf, 5)
    vector = vector_to_array("features")
    cells = [vector[i].alias(f"feature_{i}") for i in range(shape.features)]
    return comparable(data.select("customer", F.col("label").cast("long").alias("label"), *cells))


def ltv_fold_sizes(spark, sf):
    data, _ = _training_data(spark, sf, 5)
    sizes = data.groupBy(F.col("label").cast("long").alias("label"), "fold").agg(F.count("*").alias("customers"))
    return comparable(sizes)


def ltv_nearest_neighbors(spark, sf):
    """Label of each trimmed customer by the vote of its five nearest, itself included."""
    data, _ = _training_data(spark, sf, 5)
    predicted = NearestNeighbors(k=5).fit(data).transform(data)
    return comparable(predicted.select("customer", F.col("prediction").cast("long").alias("prediction")))


def _predictor(spark, sf, families):
    predictor = LifetimeValuePredictor(RFMSegmentation(orders_base(spark, sf)))
    predictor.choose_best_predictor(cv=5, grids={f: SEARCH_GRIDS[f] for f in families})
    return predictor


# Families whose scores SQL can compute.
SCORED_BY_SQL = ("knn", "naive_bayes", "decision_tree")


def _scores(family):
    """The predictor's scores; of families that train by iteration, what can be said of them without their model."""

    def query(spark, sf):
        if family in SCORED_BY_SQL:
            return comparable(_predictor(spark, sf, [family]).predictor_scores)
        predictor = LifetimeValuePredictor(RFMSegmentation(orders_base(spark, sf)))
        data, shape = predictor.training_data(cv=5)
        best = search(data, {family: SEARCH_GRIDS[family]}, shape, 5)[0]
        counts = data.groupBy("label").agg(F.count("*").alias("n"))
        total, largest = F.sum("n"), F.max("n")
        return comparable(
            counts.agg(
                F.lit(family).alias("model"),
                total.alias("customers"),
                F.count("*").alias("classes"),
                F.lit(len(SEARCH_GRIDS[family])).alias("points"),
                F.lit(5).alias("folds"),
                (largest / total).alias("majority_share"),
                (F.lit(best.best_score) > largest / total).alias("beats_majority"),
            )
        )

    query.__name__ = f"ltv_scores_{family}"
    return query


def ltv_predict(spark, sf):
    """Train a family on the customers and score the lineitem segmentation."""
    predictor = _predictor(spark, sf, ["naive_bayes"])
    return comparable(predictor.run_best_predictor(RFMSegmentation(lineitem_base(spark, sf))))


# Suite


def suite_result_sizes(spark, sf):
    """Rows of every result frame of the suite, computed on one cached base."""
    with FullAnalysis(orders_base(spark, sf)) as suite:
        sizes = [
            frame.agg(F.lit(report).alias("report"), F.lit(name).alias("result"), F.count("*").alias("row_count"))
            for report, frames in suite.analysis_data().items()
            for name, frame in frames.items()
        ]
        whole = sizes[0]
        for size in sizes[1:]:
            whole = whole.unionByName(size)
        # One row per result, computed while the cache is held.
        return materialize(whole)


# The frames of the suite: report, name, the registered query that gives the same frame with its rows, and the columns
# that are summed up.  Frames of one measure or pair are parts of their query.
_INDEXES = tuple(f"index_{i}" for i in cohort.INDEXES)
_NEW = ("Existing", "New", "New Percent")
DATA_FRAMES = [
    ("Basic Info data", "total_revenue", "basic_total_revenue", ("total_revenue",)),
    ("Basic Info data", "unique_customer", "basic_unique_customer", ("unique_customer",)),
    ("Basic Info data", "customer_revenue", "basic_customer_revenue", ("sale",)),
    ("Basic Info data", "avg_customer_revenue", "basic_avg_customer_revenue", ("avg_customer_revenue",)),
    ("Basic Info data", "segment_revenue", "basic_segment_revenue", ("sale", "percent")),
    ("Basic Info data", "segment_unique_customer", "basic_segment_unique_customer", ("customer", "percent")),
    ("Growth data", "monthly_revenue", "growth_monthly_revenue", ("sale",)),
    ("Growth data", "monthly_customer", "growth_monthly_customer", ("customer",)),
    ("Growth data", "segment_monthly_revenue", "growth_segment_monthly_revenue", ("sale",)),
    ("Growth data", "segment_monthly_customer", "growth_segment_monthly_customer", ("customer",)),
    ("New Existing Customer data", "count", "new_existing_count", ("count type",)),
    ("New Existing Customer data", "month_new_percent", "new_existing_month_new_percent", _NEW),
    ("New Existing Customer data", "type_percent", "new_existing_type_percent", ("type_percent",)),
    ("New Existing Customer data", "segment_count", "new_existing_segment_count", ("customer",)),
    ("New Existing Customer data", "segment_monthly_new_percent", "new_existing_segment_monthly_new_percent", _NEW),
    ("Retention data", "by_customer", "retention_by_customer", None),
    ("Retention data", "by_month", "retention_by_month", (retention.TOTAL, retention.RETAINED, retention.RATE)),
    *[("Cohort data", name, f"cohort_{name}", _INDEXES) for name in ("by_revenue", "by_revenue_pct", "by_retention", "by_retention_pct")],
    ("Segmentation data", "rfm", "rfm_measures", rfm.MEASURES),
    ("Segmentation data", "segment", "rfm_segment", (*rfm.CLUSTERS, rfm.SCORE)),
]
CHART_FRAMES = [
    *[
        (report.replace(" data", " chart"), name, query, columns)
        for report, name, query, columns in DATA_FRAMES
        if report.split(" data")[0] in ("Growth", "New Existing Customer", "Cohort") or name in ("customer_revenue", "segment_revenue", "segment_unique_customer")
    ],
    ("Retention chart", "retention", "retention_by_month_long", ("count",)),
    ("Retention chart", "retention_pct", "retention_by_month", (retention.RATE,)),
    *[("Segmentation chart", m.lower(), f"rfm_histograms/measure={m}", ("bin_start", "bin_end", "count")) for m in rfm.MEASURES],
    *[("Segmentation chart", f"{x}_{y}".lower(), f"rfm_trends/x={x}/y={y}", ("slope", "intercept", "r2", "points")) for x, y in rfm.PAIRS],
]
# Digits to which columns are rounded before they are summed, other than six; revenues of cohorts too.
_DIGITS = {"sale": 2, "total_revenue": 2, "avg_customer_revenue": 4, "bin_start": 2, "bin_end": 2, "slope": 4, "intercept": 4}


def _summed(suite_frames: dict, frames: list) -> DataFrame:
    """Rows and the sum of all values of each frame."""
    rows = []
    for report, name, query, columns in frames:
        frame = suite_frames[report][name]
        # A matrix has a column for each month or index that occurs.
        matrix = columns in (None, _INDEXES)
        own = [c for c in frame.columns if c not in ("customer", cohort.COHORT)] if matrix else list(columns)
        digits = {c: 2 for c in own} if query == "cohort_by_revenue" else _DIGITS
        frame = comparable(frame, **{c: d for c, d in digits.items() if c in frame.columns})
        whole = sum((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in own[1:]), F.coalesce(F.col(f"`{own[0]}`").cast("double"), F.lit(0.0)))
        rows.append(frame.agg(F.lit(report).alias("report"), F.lit(name).alias("result"), F.count("*").alias("row_count"), F.round(F.sum(whole), 2).alias("total")))
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row)
    # One row per frame, computed while the suite holds its base.
    return materialize(stacked)


def suite_checksums(spark, sf):
    """Rows and sums of every result frame of the suite."""
    with FullAnalysis(orders_base(spark, sf)) as suite:
        return _summed(suite.analysis_data(), DATA_FRAMES)


def suite_charts(spark, sf):
    """Rows and sums of every frame that a chart is drawn from."""
    with FullAnalysis(orders_base(spark, sf)) as suite:
        return _summed(suite.chart_data(), CHART_FRAMES)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        bind_rows,
        bind_segment_filter,
        bind_inline_segment_filter,
        bind_no_segment,
        bind_without_date,
        bind_calendar_filter,
        bind_all_filters,
        bind_text_dates,
        bind_text_short_years,
        bind_integer_sale,
        bind_calendar_years,
        bind_calendar_months,
        bind_calendar_days,
        bind_row_count,
        bind_activity,
        basic_total_revenue,
        basic_unique_customer,
        basic_customer_revenue,
        basic_avg_customer_revenue,
        basic_segment_revenue,
        basic_segment_unique_customer,
        basic_totals_without_date,
        basic_segment_unique_customer_events,
        basic_totals_filtered,
        growth_monthly_revenue,
        growth_monthly_customer,
        growth_segment_monthly_revenue,
        growth_segment_monthly_customer,
        growth_monthly_revenue_lineitem,
        new_existing_rows,
        new_existing_count,
        new_existing_month_new_percent,
        new_existing_type_percent,
        new_existing_segment_count,
        new_existing_segment_monthly_new_percent,
        new_existing_month_new_percent_events,
        new_existing_type_percent_filtered,
        retention_activity,
        retention_by_customer,
        retention_by_month,
        retention_by_month_long,
        retention_by_month_chronological,
        retention_by_month_filtered,
        cohort_cells,
        cohort_by_revenue,
        cohort_by_revenue_pct,
        cohort_by_retention,
        cohort_by_retention_pct,
        rfm_measures,
        rfm_measures_lineitem,
        rfm_measures_events,
        rfm_clusters,
        rfm_segment,
        rfm_segment_sizes,
        rfm_rank_clusters,
        rfm_histogram_recency,
        rfm_histogram_frequency,
        rfm_histogram_monetary,
        rfm_histograms,
        rfm_trends,
        ltv_feature_frame,
        ltv_feature_rows_events,
        ltv_cluster_hint,
        ltv_trim_highest,
        ltv_trim_quantile,
        ltv_clusters,
        ltv_cluster_info,
        ltv_features,
        ltv_fold_sizes,
        ltv_nearest_neighbors,
        *[_scores(family) for family in SEARCH_GRIDS],
        ltv_predict,
        suite_result_sizes,
        suite_checksums,
        suite_charts,
    )
}
