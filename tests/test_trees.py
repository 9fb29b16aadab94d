"""Exact trees against a plain greedy search, and their cross-validation."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from patronage.operators import trees
from patronage.operators.trees import DIGITS, ExactTreeClassifier, ExactTreeModel


def impurity(criterion, counts):
    n = sum(counts)
    if not n:
        return 0
    if criterion == "gini":
        return -sum(c * c for c in counts) / n
    return n * math.log(n) - sum(c * math.log(c) for c in counts if c)


def plain(rows, labels, criterion, depth, classes):
    """A nested (counts, feature, threshold, left, right)."""
    counts = [int((labels == c).sum()) for c in range(classes)]
    best = None
    if depth and sum(c > 0 for c in counts) > 1:
        for j in range(rows.shape[1]):
            values = np.unique(rows[:, j])
            for a, b in zip(values[:-1], values[1:]):
                left = rows[:, j] <= a
                parts = [[int((labels[side] == c).sum()) for c in range(classes)] for side in (left, ~left)]
                middle = (a + b) / 2
                score = round(sum(impurity(criterion, p) for p in parts), DIGITS)
                found = (score, j, middle if middle < b else a)
                best = min(best, found) if best else found
    if best is None:
        return counts, None, None, None, None
    left = rows[:, best[1]] <= best[2]
    return counts, best[1], best[2], *[plain(rows[side], labels[side], criterion, depth - 1, classes) for side in (left, ~left)]


def nested(tree, at=0):
    if tree.left[at] < 0:
        return tree.counts[at], None, None, None, None
    return tree.counts[at], tree.feature[at], tree.threshold[at], nested(tree, tree.left[at]), nested(tree, tree.left[at] + 1)


def sample(n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = np.column_stack([rng.normal(size=n), rng.integers(0, 4, size=n), rng.integers(0, 2, size=n), np.round(rng.normal(size=n), 1)])
    labels = ((rows[:, 0] > 0.3).astype(int) + (rows[:, 1] > 1) * (rows[:, 3] > 0) + (rng.random(n) < 0.1)) % 3
    return rows, labels, rng.integers(0, 3, size=n)


def frame(spark, rows, labels, folds):
    data = [(i, Vectors.dense(r), float(c), int(f)) for i, (r, c, f) in enumerate(zip(rows, labels, folds))]
    return spark.createDataFrame(data, ["i", "features", "label", "fold"])


def as_vectors(df):
    return df.select(trees.vector_to_array("features").alias("vector"), F.col("label").cast("long").alias("label"), "fold")


@pytest.mark.parametrize("values", [100_000, 25])
def test_equal_to_a_plain_search(spark, values):
    rows, labels, folds = sample()
    data = as_vectors(frame(spark, rows, labels, folds)).repartition(3).cache()
    wanted = [(c, f) for c in ("gini", "entropy") for f in (-1, 0, 2)]
    grown = trees.grow(data, wanted, 6, rows.shape[1], 3, values)
    for tree, (criterion, fold) in zip(grown, wanted):
        mine = folds != fold
        assert nested(tree) == plain(rows[mine], labels[mine], criterion, 6, 3)
    shares = trees.hits(data, grown, [2, 6])
    for t, (criterion, fold) in enumerate(wanted):
        if fold < 0:
            continue
        for depth in (2, 6):
            mine = folds != fold
            want = plain(rows[mine], labels[mine], criterion, depth, 3)

            def label(row, node):
                while node[1] is not None:
                    node = node[3] if row[node[1]] <= node[2] else node[4]
                return int(np.argmax(node[0]))

            right = [label(r, want) == c for r, c in zip(rows[~mine], labels[~mine])]
            assert shares[t, depth] == pytest.approx(np.mean(right))
    data.unpersist()


def test_more_values_than_any_bin_limit(spark):
    """Classes that only a threshold between two particular neighbours of 5,000 values parts."""
    rows = np.arange(5000, dtype=float)[:, None]
    labels = (rows[:, 0] > 3210).astype(int)
    df = frame(spark, rows, labels, np.zeros(5000))
    model = ExactTreeClassifier(maxDepth=1).fit(df)
    assert model.tree.threshold[0] == 3210.5
    assert model.transform(df).where("prediction <> label").isEmpty()


def test_model_is_saved_and_cut(spark, tmp_path):
    rows, labels, folds = sample(120, 3)
    df = frame(spark, rows, labels, folds)
    model = ExactTreeClassifier(criterion="entropy", maxDepth=4, predictionCol="guess").fit(df)
    want = {r.i: r.guess for r in model.transform(df).collect()}
    for saved, kind in ((model, ExactTreeModel), (PipelineModel([model]), PipelineModel)):
        path = str(tmp_path / kind.__name__)
        saved.write().overwrite().save(path)
        assert {r.i: r.guess for r in kind.load(path).transform(df).collect()} == want
    model._set(maxDepth=0)
    assert {r.guess for r in model.transform(df).collect()} == {float(np.bincount(labels).argmax())}


def test_one_class_one_row_and_ties(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 1.0), (Vectors.dense([2.0]), 1.0)], ["features", "label"])
    assert {r.prediction for r in ExactTreeClassifier().fit(df).transform(df).collect()} == {1.0}
    tied = spark.createDataFrame([(Vectors.dense([0.0, 0.0]), 0.0), (Vectors.dense([1.0, 1.0]), 1.0)], ["features", "label"])
    tree = ExactTreeClassifier().fit(tied).tree
    assert (tree.feature[0], tree.threshold[0]) == (0, 0.5)
    same = spark.createDataFrame([(Vectors.dense([3.0]), 0.0), (Vectors.dense([3.0]), 1.0)], ["features", "label"])
    assert {r.prediction for r in ExactTreeClassifier().fit(same).transform(same).collect()} == {0.0}
    with pytest.raises(ValueError, match="criteria"):
        ExactTreeClassifier(criterion="other").fit(df)
