"""One-dimensional k-means over Spark columns.

On a line the clusters of k-means are intervals, so a model is a sorted list of
boundaries and an assignment is a comparison.  Fitting takes three steps:

1. Spark reduces each column to the count and sum of one or two thousand bins.
   Their number has a fixed bound, whatever the number of rows.  A first pass
   counts coarse bins, a second one splits those that hold many rows.
2. The best clustering of the bins is found by dynamic programming on the
   driver (as in Wang and Song, *Ckmeans.1d.dp*, 2011).  This takes the place
   of repeated random starts.
3. Lloyd iterations over all the values start from there and stop by the usual
   tolerance, as a rule after very few passes.  One aggregation moves the
   centers of every problem, and one row per center returns to the driver.

Clusters are numbered by their means.  Bins depend on extremes and counts only,
so equal input gives equal labels however it is partitioned.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

# Defaults of the usual k-means estimator.
N_INIT = 10
MAX_ITER = 300
TOL = 1e-4

# Coarse bin edges per column: even steps, and steps that halve every fourth
# time towards either end to keep long tails apart.
STEPS = 250
HALVINGS = 120
# A coarse bin with more than one part in SHARES of the rows is split, twice as
# often as it holds such parts.
SHARES = 500


@dataclass(frozen=True)
class Problem:
    name: str
    column: str
    k: int


@dataclass(frozen=True)
class Clusters:
    """A fitted problem: cluster means in ascending order and what separates them."""

    column: str
    means: list[float]
    sizes: list[int]
    boundaries: list[float]
    inertia: float
    iterations: int

    def rank(self, descending: bool = False) -> Column:
        """0 for the cluster with the lowest mean, or the highest if descending."""
        value = F.col(self.column)
        above = [(value > F.lit(b)).cast("int") for b in self.boundaries]
        rank = reduce(lambda a, b: a + b, above, F.when(value.isNotNull(), 0))
        return F.lit(len(self.means) - 1) - rank if descending else rank


def fit(df: DataFrame, problems: list[Problem], max_iter: int = MAX_ITER, tol: float = TOL) -> dict[str, Clusters]:
    """Fit every problem on ``df``, which is read a few times; nulls take no part."""
    columns = sorted({p.column for p in problems})
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    summaries = _summaries(values, columns)
    for p in problems:
        if summaries[p.column]["n"] < p.k:
            raise ValueError(f"{p.column}: {summaries[p.column]['n']} values for {p.k} clusters")
    centers = _starts(values, problems, summaries)
    rounds = _refine(values, centers, {p.name: p.column for p in problems}, summaries, max_iter, tol)
    return _measure(values, centers, problems, rounds)


def _summaries(values, columns):
    """Count, range and variance of each column, in one job."""
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [
            F.count(c).alias(f"n{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
            F.var_pop(c).alias(f"var{i}"),
        ]
    row = values.agg(*aggregates).first()
    return {c: {name: row[f"{name}{i}"] for name in ("n", "min", "max", "var")} for i, c in enumerate(columns)}


def coarse_edges(summary: dict) -> list[float]:
    low, high = summary["min"], summary["max"]
    span = high - low
    shares = [math.pow(2.0, -i / 4) for i in range(1, HALVINGS + 1)]
    edges = {low + span * i / STEPS for i in range(1, STEPS)}
    edges.update(low + span * s for s in shares)
    edges.update(high - span * s for s in shares)
    return sorted(edges)


def split_edges(bins: list) -> list[float]:
    """Edges that split the full bins evenly between their lowest and highest value."""
    n = sum(b["weight"] for b in bins)
    edges = set()
    for b in bins:
        if b["weight"] * SHARES > n:
            parts = 2 * -(-b["weight"] * SHARES // n)
            edges.update(b["low"] + (b["high"] - b["low"]) * i / parts for i in range(1, parts))
    return sorted(edges)


def _bins(values, edges):
    """Weight, sum and range of the filled bins of each column, in order.

    At most ``len(edges) + 1`` rows per column come to the driver.
    """
    counted = []
    for c, column_edges in edges.items():
        column = values.select(F.col(c).alias("value")).filter(F.col("value").isNotNull())
        splits = [-math.inf, *column_edges, math.inf]
        binned = Bucketizer(splits=splits, inputCol="value", outputCol="bin").transform(column)
        counted.append(
            binned.groupBy("bin")
            .agg(
                F.count("*").alias("weight"),
                F.sum("value").alias("total"),
                F.min("value").alias("low"),
                F.max("value").alias("high"),
            )
            .withColumn("column", F.lit(c))
        )
    rows = sorted(reduce(DataFrame.unionByName, counted).collect(), key=lambda r: r["bin"])
    return {c: [r for r in rows if r["column"] == c] for c in edges}


def _starts(values, problems, summaries):
    """Means of the best clusters of the binned columns, per problem."""
    edges = {c: coarse_edges(summary) for c, summary in summaries.items()}
    coarse = _bins(values, edges)
    fine = _bins(values, {c: sorted({*edges[c], *split_edges(coarse[c])}) for c in edges})
    starts = {}
    for c, bins in fine.items():
        weights = np.array([r["weight"] for r in bins], dtype=float)
        totals = np.array([r["total"] for r in bins], dtype=float)
        wanted = {p.name: p.k for p in problems if p.column == c}
        best = optimal_means(weights, totals, max(wanted.values()))
        for name, k in wanted.items():
            starts[name] = best[min(k, len(bins)) - 1]
    return starts


def optimal_means(weights: np.ndarray, totals: np.ndarray, k: int) -> list[list[float]]:
    """Cluster means of the best 1, 2, ... k clusters of sorted weighted bins."""
    n = len(weights)
    points = totals / weights
    points = points - np.average(points, weights=weights)
    w, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weights, weights * points, weights * points**2))
    first, last = np.arange(n)[:, None], np.arange(1, n + 1)[None, :]
    inside = last > first
    weight = np.where(inside, w[last] - w[first], 1.0)
    cost = np.where(inside, q[last] - q[first] - (s[last] - s[first]) ** 2 / weight, np.inf)
    best, cuts, means = cost[0], [], []
    for m in range(1, min(k, n) + 1):
        if m > 1:
            through = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
            cuts.append(through.argmin(axis=0))
            best = through.min(axis=0)
        bounds, end = [n], n
        for cut in reversed(cuts):
            end = int(cut[end - 1])
            bounds.append(end)
        bounds.append(0)
        bounds.reverse()
        means.append([float(totals[a:b].sum() / weights[a:b].sum()) for a, b in zip(bounds, bounds[1:])])
    return means


def _assigned(values, centers, column_of):
    """Values in long form with the cluster each has in every problem of its column.

    The centers travel inside the plan as one literal of a few numbers each.
    """
    by_column: dict[str, list] = {}
    for name, cs in centers.items():
        middles = [(a + b) / 2 for a, b in zip(cs, cs[1:])]
        by_column.setdefault(column_of[name], []).append({"name": name, "centers": cs, "middles": middles})
    schema = "map<string, array<struct<name:string, centers:array<double>, middles:array<double>>>>"
    literal = F.from_json(F.lit(json.dumps(by_column)), schema)
    columns = sorted(by_column)
    if len(columns) == 1:
        long = values.select(F.lit(columns[0]).alias("column"), F.col(columns[0]).alias("value"))
    else:
        long = values.select(*columns).unpivot([], columns, "column", "value")
    exploded = long.filter(F.col("value").isNotNull()).withColumn("p", F.explode(literal[F.col("column")]))
    widest = max(len(cs) for cs in centers.values()) - 1
    above = [F.coalesce((F.col("value") > F.get("p.middles", F.lit(j))).cast("int"), F.lit(0)) for j in range(widest)]
    cluster = reduce(lambda a, b: a + b, above, F.lit(0))
    return exploded.select(
        F.col("p.name").alias("name"), cluster.alias("cluster"), F.col("p.centers").alias("centers"), "value"
    )


def _refine(values, centers, column_of, summaries, max_iter, tol):
    """Move centers to the means of their clusters until they settle; rounds taken."""
    rounds = dict.fromkeys(centers, 0)
    moving = set(centers)
    for _ in range(max_iter):
        if not moving:
            break
        means = (
            _assigned(values, {name: centers[name] for name in moving}, column_of)
            .groupBy("name", "cluster")
            .agg(F.avg("value").alias("mean"))
            .collect()
        )
        moved = {(m["name"], m["cluster"]): m["mean"] for m in means}
        for name in list(moving):
            # A cluster that lost all its values keeps its center.
            after = [moved.get((name, j), c) for j, c in enumerate(centers[name])]
            shift = sum((a - b) ** 2 for a, b in zip(after, centers[name]))
            centers[name] = after
            rounds[name] += 1
            if shift <= tol * summaries[column_of[name]]["var"]:
                moving.discard(name)
    return rounds


def _measure(values, centers, problems, rounds):
    """Size, mean and inertia of the final clusters."""
    distance = F.col("value") - F.get("centers", F.col("cluster"))
    cells = (
        _assigned(values, centers, {p.name: p.column for p in problems})
        .groupBy("name", "cluster")
        .agg(
            F.count("*").alias("size"),
            F.avg("value").alias("mean"),
            F.sum(distance * distance).alias("inertia"),
        )
        .collect()
    )
    fitted = {}
    for p in problems:
        filled = {c["cluster"]: c for c in cells if c["name"] == p.name}
        order = sorted(filled)
        cs = centers[p.name]
        fitted[p.name] = Clusters(
            column=p.column,
            means=[filled[j]["mean"] for j in order],
            sizes=[filled[j]["size"] for j in order],
            boundaries=[(cs[j - 1] + cs[j]) / 2 for j in order[1:]],
            inertia=sum(filled[j]["inertia"] for j in order),
            iterations=rounds[p.name],
        )
    return fitted


def fit_mllib(df: DataFrame, problem: Problem, n_init: int = N_INIT, max_iter: int = MAX_ITER, seed: int = 1) -> Clusters:
    """The same model from ``pyspark.ml`` k-means: the best of ``n_init`` seeded starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    values = df.select(F.col(problem.column).cast("double").alias("value")).filter(F.col("value").isNotNull())
    vectors = VectorAssembler(inputCols=["value"], outputCol="features").transform(values)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = vectors.count()
        if n < problem.k:
            raise ValueError(f"{problem.column}: {n} values for {problem.k} clusters")
        if problem.k == 1:
            mean, var = vectors.agg(F.avg("value"), F.var_pop("value")).first()
            return Clusters(problem.column, [mean], [n], [], var * n, 0)
        models = [
            KMeans(k=problem.k, maxIter=max_iter, tol=TOL, seed=seed + i).fit(vectors) for i in range(n_init)
        ]
        best = min(models, key=lambda m: m.summary.trainingCost)
        sizes = best.summary.clusterSizes
        centers = [float(c[0]) for c in best.clusterCenters()]
        order = sorted((j for j in range(len(centers)) if sizes[j] > 0), key=lambda j: centers[j])
        means = [centers[j] for j in order]
        return Clusters(
            column=problem.column,
            means=means,
            sizes=[sizes[j] for j in order],
            boundaries=[(a + b) / 2 for a, b in zip(means, means[1:])],
            inertia=best.summary.trainingCost,
            iterations=best.summary.numIter,
        )
    finally:
        vectors.unpersist()
