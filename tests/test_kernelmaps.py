"""Feature maps against their kernels."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from patronage.operators.kernelmaps import DEGREE, FOURIER_FEATURES, KernelFeatures, scale
from patronage.operators.models import ESTIMATORS, Shape, accuracy


def frame(spark, rows, labels=None):
    labels = np.zeros(len(rows)) if labels is None else labels
    return spark.createDataFrame([(i, Vectors.dense(r), float(c)) for i, (r, c) in enumerate(zip(rows, labels))], ["i", "features", "label"])


def mapped(model, df):
    return np.array([r.mapped.toArray() for r in model.transform(df).orderBy("i").collect()])


def test_polynomial_map_is_exact(spark):
    rows = np.random.default_rng(1).random((20, 5))
    df = frame(spark, rows)
    width, gamma = scale(df, "features")
    assert (width, gamma) == (5, pytest.approx(1 / (5 * rows.var())))
    out = mapped(KernelFeatures(kernel="poly").fit(df), df)
    assert np.allclose(out @ out.T, (gamma * rows @ rows.T) ** DEGREE)


def test_fourier_map_is_within_its_error_and_saved(spark, tmp_path):
    rows = np.random.default_rng(2).random((40, 5))
    df = frame(spark, rows)
    _, gamma = scale(df, "features")
    model = KernelFeatures(kernel="rbf").fit(df)
    out = mapped(model, df)
    kernel = np.exp(-gamma * ((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    error = out @ out.T - kernel
    assert np.sqrt((error**2).mean()) < 1 / np.sqrt(FOURIER_FEATURES) and np.abs(error).max() < 6 / np.sqrt(FOURIER_FEATURES)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    assert np.array_equal(mapped(PipelineModel.load(str(tmp_path / "m")), df), out)
    with pytest.raises(ValueError, match="kernel"):
        KernelFeatures(kernel="other").fit(df)


def test_kernels_part_what_a_line_cannot(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 2))
    labels = ((rows**2).sum(axis=1) > 1.2).astype(int)
    df = frame(spark, rows, labels).cache()
    shares = {}
    for kernel in ("linear", "rbf"):
        model = ESTIMATORS["svc"]({"C": 10, "kernel": kernel, "max_iter": 30}, Shape(300, 2, 2)).fit(df)
        shares[kernel] = accuracy(model.transform(df))
    assert shares["rbf"] > 0.93 > 0.75 > shares["linear"]
    df.unpersist()
