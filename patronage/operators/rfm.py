"""Recency, frequency and monetary value, their clusters and the value segment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import known, total
from .kmeans1d import Problem, fit, fit_mllib
from .materialize import cut, materialize

MEASURES = ("Recency", "Frequency", "Monetary")
# Largest number of clusters that one task orders and whose ranks are broadcast.
MOST_CLUSTERS = 10_000
CLUSTERS = ("Recency cluster", "Frequency cluster", "Monetary cluster")
SCORE, SEGMENT = "RFM Overall Score", "RFM Segment"
REVENUE = "Total Revenue"
# Segment names from the lowest score to the highest.
LOW, MID, HIGH = "Low Value", "Mid Value", "High Value"

PAIRS = (("Recency", "Frequency"), ("Recency", "Monetary"), ("Frequency", "Monetary"))


def customers(measures: DataFrame) -> DataFrame:
    """Last purchase, dated purchases and revenue of each customer."""
    return _by_customer(measures.filter(known("customer")))


def _by_customer(measures: DataFrame, *added: Column) -> DataFrame:
    return measures.groupBy("customer").agg(
        F.max("last_date").alias("MaxPurchaseDate"), F.sum("n_dates").alias("purchases"), total("sale").alias(REVENUE), *added
    )


def rfm(measures: DataFrame, with_revenue: bool = False) -> DataFrame:
    """Recency in days, frequency and revenue, each over the number of months.

    The source is read once, to a materialized row per customer with the set of
    its months (bounded by the calendar).  The number of months and the latest
    date come from those rows.  Months of purchases without a customer count,
    their dates do not.
    """
    frame = materialize(_by_customer(measures, F.collect_set("ym").alias("months")))
    each = frame.select("customer", "MaxPurchaseDate", F.explode_outer("months").alias("ym"))
    span = each.agg(F.count_distinct("ym").alias("months"), F.max(F.when(known("customer"), F.col("MaxPurchaseDate")).cast("string")).alias("latest")).first()
    months = F.lit(span.months)
    # Whole days by the wall clock: a difference of timestamps without zone.
    days = F.extract(F.lit("DAY"), F.lit(span.latest).cast("timestamp_ntz") - F.col("MaxPurchaseDate"))
    return frame.filter(known("customer")).select(
        "customer",
        "MaxPurchaseDate",
        F.try_divide(days, months).alias("Recency"),
        F.try_divide(F.col("purchases"), months).alias("Frequency"),
        F.try_divide(F.col(REVENUE), months).alias("Monetary"),
        *([REVENUE] if with_revenue else []),
    )


def clustered(frame: DataFrame, clusters: tuple[int, int, int] = (4, 4, 4), method: str = "lloyd", **options) -> DataFrame:
    """Add the three cluster ranks; 0 is the least valuable cluster.

    Recency ranks from the longest absence to the most recent purchase.
    ``frame`` is read many times, so it should be materialized.
    """
    problems = [Problem(m, m, k) for m, k in zip(MEASURES, clusters)]
    if method == "lloyd":
        fitted = fit(frame, problems, **options)
    elif method == "mllib":
        fitted = {p.name: fit_mllib(frame, p, **options) for p in problems}
    else:
        raise ValueError(f"method must be 'lloyd' or 'mllib', got {method!r}")
    return frame.withColumns(
        {c: fitted[m].rank(descending=m == "Recency") for m, c in zip(MEASURES, CLUSTERS)}
    )


def rank_clusters(df: DataFrame, cluster: str, value: str, descending: bool = False, most: int = MOST_CLUSTERS) -> DataFrame:
    """Replace arbitrary cluster labels by 0..k-1 in the order of their mean ``value``.

    For labels that come from elsewhere.  Up to ``most`` clusters are ordered by
    one task and their ranks broadcast, so the rows stay where they are.  More
    are ordered in ranges of their means, each of which continues where the one
    before it ended, and joined by a shuffle.
    """
    means = cut(df.filter(known(cluster)).groupBy(cluster).agg((F.avg(value) * (-1 if descending else 1)).alias("mean")))
    clusters = means.count()
    order = [F.col("mean").asc_nulls_first() if not descending else F.col("mean").asc_nulls_last(), cluster]
    shares = [i / math.ceil(clusters / most) for i in range(1, math.ceil(clusters / most))]
    if not shares:
        ranks = means.select(cluster, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).alias("rank"))
        return _ranked(df, F.broadcast(ranks), cluster)
    # A bounded array, as a higher-order function cannot hold a subquery.
    edges = F.array(*[F.lit(float(x)) for x in sorted(set(means.agg(F.percentile_approx("mean", shares, 100 * len(shares))).first()[0] or []))])
    missing = F.lit(-1 if not descending else len(shares) + 1)
    placed = means.withColumn("range", F.when(known("mean"), F.size(F.filter(edges, lambda e: e < F.col("mean")))).otherwise(missing))
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranks = placed.withColumn("place", place).join(F.broadcast(offsets), "range").select(cluster, (F.col("offset") + F.col("place") - 1).alias("rank"))
    return _ranked(df, ranks, cluster)


def _ranked(df: DataFrame, ranks: DataFrame, cluster: str) -> DataFrame:
    return df.join(ranks, cluster, "left").drop(cluster).withColumnRenamed("rank", cluster)


def scored(frame: DataFrame) -> DataFrame:
    """Add the overall score, which is the sum of the three ranks."""
    score = F.col(CLUSTERS[0]) + F.col(CLUSTERS[1]) + F.col(CLUSTERS[2])
    return frame.withColumn(SCORE, score)


def segmented(frame: DataFrame) -> DataFrame:
    """Add the value segment: thirds of the highest score that was reached."""
    third = F.floor(frame.agg(F.max(SCORE)).scalar() / 3)
    return frame.withColumn(SEGMENT, _segment(F.col(SCORE), third))


def _segment(score: Column, third: Column) -> Column:
    # The upper test comes first: with a highest score below 3 both hold.
    return F.when(score > third * 2, HIGH).when(score > third, MID).when(score.isNotNull(), LOW)


def histograms(frame: DataFrame, measures: tuple[str, ...] = MEASURES, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins over the range of each measure, stacked; empty bins are absent.

    One aggregation finds all ranges and one counts all bins.
    """
    ends = [f(m).alias(f"{end}{i}") for i, m in enumerate(measures) for end, f in (("low", F.min), ("high", F.max))]
    bounds = frame.agg(F.struct(*ends)).scalar()

    def cell(i: int, measure: str) -> Column:
        low, high, value = bounds[f"low{i}"].cast("double"), bounds[f"high{i}"].cast("double"), F.col(measure)
        # The largest value belongs to the last bin, and a constant measure to the first.
        number = F.when(low == high, F.lit(1)).otherwise(F.least(F.width_bucket(value, low, high, F.lit(bins)), F.lit(bins)))
        return F.when(known(measure), F.struct(F.lit(measure).alias("measure"), number.cast("long").alias("bin"), low.alias("low"), high.alias("high")))

    cells = frame.select(F.explode(F.array(*[cell(i, m) for i, m in enumerate(measures)])).alias("cell")).where("cell is not null")
    return (
        cells.select("cell.*")
        .groupBy("measure", "bin", "low", "high")
        .agg(F.count("*").alias("count"))
        .select(
            "measure",
            "bin",
            (F.col("low") + (F.col("bin") - 1) * (F.col("high") - F.col("low")) / bins).alias("bin_start"),
            (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins).alias("bin_end"),
            "count",
        )
        .repartition(1)
        .sortWithinPartitions("measure", "bin")
    )


def histogram(frame: DataFrame, measure: str, bins: int = 30) -> DataFrame:
    """:func:`histograms` of one measure."""
    return histograms(frame, (measure,), bins)


def trends(segment: DataFrame, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """Least-squares lines of the second measure on the first within each value segment, for all pairs from one pass."""
    lines = [
        F.struct(
            F.lit(x).alias("x"),
            F.lit(y).alias("y"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
        )
        for x, y in pairs
    ]
    grouped = segment.groupBy(SEGMENT).agg(F.array(*lines).alias("lines"), F.count("*").alias("points"))
    stacked = grouped.select(SEGMENT, "points", F.explode("lines").alias("line"))
    return (
        stacked.select("line.x", "line.y", SEGMENT, "line.slope", "line.intercept", "line.r2", "points")
        .repartition(1)
        .sortWithinPartitions("x", "y", SEGMENT)
    )


def trend(segment: DataFrame, x: str, y: str) -> DataFrame:
    """:func:`trends` of one pair."""
    return trends(segment, ((x, y),))
