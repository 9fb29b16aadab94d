"""Naive Bayes for every fold left out against one fit per fold."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from patronage.operators.bayes import fold_accuracies
from patronage.operators.models import accuracy


def frame(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, size=n)
    rows = np.column_stack([rng.normal(size=n) + label, rng.normal(size=n) * (1 + label), rng.integers(0, 2, size=n)])
    data = [(Vectors.dense(r), float(c), int(f)) for r, c, f in zip(rows, label, rng.integers(0, 4, size=n))]
    return spark.createDataFrame(data, ["features", "label", "fold"])


def test_equal_to_a_fit_per_fold(spark):
    data = frame(spark).cache()
    want = []
    for fold in range(4):
        model = NaiveBayes(modelType="gaussian").fit(data.where(F.col("fold") != fold))
        want.append(accuracy(model.transform(data.where(F.col("fold") == fold))))
    assert fold_accuracies(data, 4) == pytest.approx(want)
    data.unpersist()


def test_two_passes_whatever_the_folds(spark):
    """One job gathers the sums of all folds, one scores all rows."""
    data = frame(spark)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("bayes", "")
    fold_accuracies(data, 4)
    few = len(tracker.getJobIdsForGroup("bayes"))
    sc.setJobGroup("bayes-more", "")
    fold_accuracies(data.withColumn("fold", F.col("fold") + 4 * (F.rand(1) > 0.5).cast("int")), 8)
    assert len(tracker.getJobIdsForGroup("bayes-more")) == few
    sc.setJobGroup("", "")


def test_a_class_or_a_fold_without_rows(spark):
    rows = [(Vectors.dense([0.0, 1.0]), 0.0, 0), (Vectors.dense([0.1, 1.0]), 0.0, 1), (Vectors.dense([5.0, 0.0]), 1.0, 0), (Vectors.dense([5.1, 0.0]), 2.0, 2)]
    data = spark.createDataFrame(rows, ["features", "label", "fold"])
    got = fold_accuracies(data, 4)
    assert len(got) == 4 and got[2] == 0.0 and got[3] == 0.0
