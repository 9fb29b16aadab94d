import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators.kmeans1d import Problem, coarse_edges, fit, fit_mllib, optimal_means, split_edges
from patronage.operators.quantile import _order_statistic, exact_quantile


def best_inertia(values, k):
    """Lowest inertia of k clusters over all ways to cut the sorted values."""
    values = np.sort(np.asarray(values, dtype=float))
    n = len(values)
    c, s = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])

    def cost(i, j):
        return s[j] - s[i] - (c[j] - c[i]) ** 2 / (j - i)

    best = [cost(0, j) if j else 0.0 for j in range(n + 1)]
    for _ in range(k - 1):
        best = [0.0] + [min(best[i] + (cost(i, j) if i < j else 0.0) for i in range(j + 1)) for j in range(1, n + 1)]
    return best[n]


def column(spark, values):
    return spark.createDataFrame([(float(v),) if v is not None else (None,) for v in values], "v double")


@pytest.mark.parametrize("shape", ["uniform", "heavy tail", "discrete"])
def test_fit_is_as_good_as_the_best_clustering(spark, shape):
    rng = random.Random(5)
    values = {
        "uniform": [rng.uniform(0, 100) for _ in range(120)],
        "heavy tail": [rng.paretovariate(0.8) for _ in range(120)],
        "discrete": [rng.choice([1, 2, 2, 3, 10, 11, 40]) for _ in range(120)],
    }[shape]
    problems = [Problem(str(k), "v", k) for k in (1, 2, 3, 4)]
    fitted = fit(column(spark, [*values, None]), problems)
    for p in problems:
        best = best_inertia(values, p.k)
        assert fitted[p.name].inertia <= best * 1.001 + 1e-9
        assert sum(fitted[p.name].sizes) == len(values)
        assert fitted[p.name].means == sorted(fitted[p.name].means)


def test_ranks_follow_the_means_and_nulls_have_none(spark):
    df = column(spark, [1, 2, 100, 101, 1000, None])
    clusters = fit(df, [Problem("p", "v", 3)])["p"]
    up = {r.v: r.r for r in df.select("v", clusters.rank().alias("r")).collect()}
    assert up == {1: 0, 2: 0, 100: 1, 101: 1, 1000: 2, None: None}
    down = {r.v: r.r for r in df.select("v", clusters.rank(descending=True).alias("r")).collect()}
    assert down == {1: 2, 2: 2, 100: 1, 101: 1, 1000: 0, None: None}


def test_fewer_distinct_values_than_clusters(spark):
    df = column(spark, [5, 5, 5, 5, 9, 9])
    clusters = fit(df, [Problem("p", "v", 4)])["p"]
    assert clusters.means == [5, 9] and clusters.sizes == [4, 2] and clusters.inertia == 0
    constant = fit(column(spark, [3, 3, 3]), [Problem("p", "v", 2)])["p"]
    assert constant.means == [3] and constant.boundaries == []


def test_fewer_rows_than_clusters_is_refused(spark):
    with pytest.raises(ValueError):
        fit(column(spark, [1, 2, None]), [Problem("p", "v", 3)])
    with pytest.raises(ValueError):
        fit_mllib(column(spark, [1, 2, None]), Problem("p", "v", 3))


def test_several_columns_are_independent(spark):
    df = spark.createDataFrame([(float(i), float(-i * i)) for i in range(40)], "a double, b double")
    both = fit(df, [Problem("a", "a", 3), Problem("b", "b", 2)])
    assert both["a"] == fit(df, [Problem("a", "a", 3)])["a"]
    assert both["b"] == fit(df, [Problem("b", "b", 2)])["b"]


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(10007)) / 7).alias("v"))
    one = fit(df.coalesce(1), [Problem("p", "v", 4)])["p"]
    many = fit(df.repartition(7), [Problem("p", "v", 4)])["p"]
    assert one.boundaries == pytest.approx(many.boundaries) and one.sizes == many.sizes


def test_mllib_method_agrees_on_separated_values(spark):
    df = column(spark, [1, 2, 3, 100, 101, 102, 500, 501])
    ours, theirs = fit(df, [Problem("p", "v", 3)])["p"], fit_mllib(df, Problem("p", "v", 3), n_init=3)
    assert ours.sizes == theirs.sizes == [3, 3, 2]
    assert ours.means == pytest.approx(theirs.means)
    assert fit_mllib(df, Problem("p", "v", 1)).inertia == pytest.approx(fit(df, [Problem("p", "v", 1)])["p"].inertia)


def test_optimal_means_of_weighted_bins():
    weights = np.array([1.0, 1.0, 2.0, 1.0])
    totals = weights * np.array([0.0, 1.0, 10.0, 11.0])
    assert optimal_means(weights, totals, 2) == [[pytest.approx(32 / 5)], [0.5, pytest.approx(31 / 3)]]


def test_bin_edges():
    edges = coarse_edges({"min": 0.0, "max": 8.0})
    assert edges == sorted(set(edges)) and 4.0 in edges and 0 < min(edges) and max(edges) < 8
    assert coarse_edges({"min": 3.0, "max": 3.0}) == [3.0]
    bins = [{"weight": 1, "low": 0.0, "high": 1.0}, {"weight": 999, "low": 2.0, "high": 3.0}]
    split = split_edges(bins)
    assert len(split) == 2 * 500 - 1 and all(2 < e < 3 for e in split)


@pytest.mark.parametrize("q", [0, 0.001, 0.25, 0.5, 0.9, 0.95, 1])
def test_quantile_interpolates(spark, q):
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 3) for _ in range(300)]
    df = column(spark, [*values, None])
    expected = float(np.quantile(values, q))
    assert exact_quantile(df, "v", q) == pytest.approx(expected)
    # The way taken for large columns.
    assert exact_quantile(df, "v", q, small=5) == pytest.approx(expected)


@pytest.mark.parametrize("q", [0.1, 0.34, 0.5, 0.66, 0.99])
def test_quantile_with_values_held_by_many_rows(spark, q):
    values = [0.0] * 100 + [7.0] * 100 + list(range(1, 101))
    df = column(spark, values)
    assert exact_quantile(df, "v", q, small=3) == pytest.approx(float(np.quantile(values, q)))


def test_large_quantile_beyond_the_accuracy_of_the_sketch(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) + 0.0).alias("v"))
    for q in (0.3, 0.999):
        expected = df.agg(F.percentile("v", q)).first()[0]
        assert exact_quantile(df, "v", q, small=1000) == pytest.approx(expected)


def test_quantile_edges(spark):
    assert exact_quantile(column(spark, [None]), "v", 0.5) is None


def test_order_statistic_is_a_value_of_the_column(spark):
    values = [i / 7 for i in range(1, 50)]
    df = column(spark, values).selectExpr("cast(v as double) as v")
    for rank in (8, 24, 30, 42):
        assert _order_statistic(df, rank, 49, values[0], values[-1], 1000) == values[rank - 1]


def test_quantile_out_of_range(spark):
    with pytest.raises(ValueError):
        exact_quantile(column(spark, [1]), "v", 1.5)
