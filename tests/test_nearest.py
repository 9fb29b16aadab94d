"""The pruned k-nearest-neighbour join against all distances, with blocks and cells forced small."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from patronage.operators import nearest
from patronage.operators.nearest import NearestNeighbors, NearestNeighborsModel


def frame(spark, points, labels):
    return spark.createDataFrame([(i, Vectors.dense(p), float(c)) for i, (p, c) in enumerate(zip(points, labels))], ["i", "features", "label"])


def brute(points, labels, queries, k):
    out = []
    for q in queries:
        away = np.zeros(len(points))
        for j in range(points.shape[1]):
            away += (points[:, j] - q[j]) ** 2
        votes = labels[np.lexsort((labels, away))[:k]]
        kinds, n = np.unique(votes, return_counts=True)
        out.append(kinds[n.argmax()])
    return out


def clouds(rows, seed, width=3):
    """Points in clouds of very different size, a third of all at one place, many ties on a grid."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width)) * 10
    at = rng.choice(7, size=rows, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.03, 0.02])
    points = centres[at] + np.round(rng.normal(size=(rows, width)), 1)
    points[: rows // 3] = centres[0]
    return points, (at + rng.integers(0, 2, size=rows)) % 3


@pytest.mark.parametrize("k", [1, 5, 40])
@pytest.mark.parametrize("size, pivots", [(16, 64), (100, 3), (7, 1)])
def test_equal_to_all_distances(spark, k, size, pivots):
    points, labels = clouds(600, 1)
    queries = np.concatenate([clouds(150, 2)[0], points[:20], np.full((1, 3), 1e6)])
    train, test = frame(spark, points, labels), frame(spark, queries, np.zeros(len(queries))).drop("label").withColumn("vector", F.lit("x"))
    model = NearestNeighbors(k=k, blockRows=size, mostPivots=pivots).fit(train.repartition(4))
    assert len(model.cells) == len(model.pivots) <= pivots
    assert model.packed.agg(F.sum(F.size("points"))).first()[0] == len({(*p, c) for p, c in zip(points, labels)})
    out = model.transform(test)
    assert out.columns == [*test.columns, "prediction"]
    got = {r.i: r.prediction for r in out.collect()}
    assert [got[i] for i in range(len(queries))] == brute(points, labels, queries, k)


def test_cells_are_ruled_out_and_hot_ones_split(spark):
    points, labels = clouds(3000, 3, width=2)
    train = frame(spark, points, labels)
    model = NearestNeighbors(k=3, blockRows=32, mostPivots=48).fit(train)
    queries = model.transform(train).select("features").distinct()
    home = nearest.at_home(queries.select(nearest.vector_to_array("features").alias("vector")), model.pivots, model.cells, 3)
    sent = nearest.elsewhere(home, model.pivots, model.cells).count()
    assert sent < 0.5 * queries.count() * len(model.cells)
    blocks = {c[0]: c[4] for c in model.cells}
    assert max(blocks.values()) > 1
    assert model.packed.agg(F.max(F.size("points"))).first()[0] < 4 * 32


def test_other_columns_few_points_and_no_points(spark):
    train = frame(spark, np.array([[0.0], [1.0]]), np.array([2, 1]))
    test = train
    model = NearestNeighbors(k=9, predictionCol="p").fit(train)
    assert [r.p for r in model.transform(test).orderBy("i").collect()] == [1.0, 1.0]
    empty = NearestNeighbors(k=3).fit(train.limit(0))
    assert [r.prediction for r in empty.transform(train).collect()] == [None, None]
    assert model.transform(train.limit(0)).collect() == []


def test_saved_alone_and_in_a_pipeline(spark, tmp_path):
    points, labels = clouds(300, 5)
    train = frame(spark, points, labels)
    model = NearestNeighbors(k=4, blockRows=20, mostPivots=9, predictionCol="guess").fit(train)
    want = {r.i: r.guess for r in model.transform(train).collect()}
    for saved, kind in ((model, NearestNeighborsModel), (PipelineModel([model]), PipelineModel)):
        path = str(tmp_path / kind.__name__)
        saved.write().overwrite().save(path)
        loaded = kind.load(path)
        assert {r.i: r.guess for r in loaded.transform(train).collect()} == want
    estimator = NearestNeighbors(k=7)
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    assert NearestNeighbors.load(str(tmp_path / "estimator")).getOrDefault("k") == 7


def test_candidates_hold_all_nearest_and_are_few():
    """Few pairs are measured exactly; equal and very near distances are all among them."""
    from patronage.operators import nearest as N

    rng = np.random.default_rng(5)
    points = np.concatenate([rng.random((500, 4)), np.repeat(rng.random((3, 4)), 20, axis=0), 1e-9 * rng.random((30, 4)) + 0.5])
    queries, k = points[::3], 4
    away = N._squared(queries, points)
    kth = np.partition(away, k - 1, axis=1)[:, k - 1]
    for most in (np.full(len(queries), np.inf), kth, kth / 2):
        row, point = N._candidates(queries, points, most, k)
        assert np.array_equal(N._squared_pairs(queries, points, row, point), away[row, point])
        want = set(zip(*np.nonzero(away <= np.minimum(kth, most)[:, None])))
        assert want <= set(zip(row, point)) and len(row) < away.size / 10
    odd = np.concatenate([points[:20], [[np.inf, 0, 0, 0], [np.nan, 0, 0, 0]]])
    with np.errstate(invalid="ignore"):
        assert set(zip(*N._candidates(points[:5], odd, np.full(5, np.inf), 2))) >= {(i, i) for i in range(5)}
