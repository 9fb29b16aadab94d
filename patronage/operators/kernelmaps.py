"""Kernels as explicit feature maps, so that a linear classifier of any number of rows can use them.

``poly`` is exact: the map holds all monomials of the degree, weighted so that
the product of two maps is (gamma <x, y>) ** degree.  ``rbf`` is approximated by
random Fourier features: the product of two maps is exp(-gamma |x - y|^2) with a
standard error of at most 1 / sqrt(features) for a pair of rows.  gamma is one
over the number of features and the variance of all their values.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

KERNELS = ("linear", "poly", "rbf")
DEGREE = 3
# Random features of an approximated kernel.
FOURIER_FEATURES = 1024


def scale(dataset: DataFrame, column: str) -> tuple[int, float]:
    """Number of features and gamma, from one aggregation."""
    r = dataset.agg(Summarizer.metrics("count", "sum", "normL2").summary(F.col(column)).alias("of")).first().of
    total, square = np.array(r["sum"]), np.array(r["normL2"]) ** 2
    cells = r["count"] * len(total)
    variance = float(square.sum() / cells - (total.sum() / cells) ** 2) if cells else 0.0
    return len(total), 1 / (len(total) * variance) if variance > 0 else 1.0


def monomial_weights(frame: DataFrame, width: int, degree: int, gamma: float) -> np.ndarray:
    """The factor of each term that Spark's polynomial expansion makes: 0 below the degree, else the root of its share in the kernel.

    A row of different primes tells which features a term multiplies.
    """
    primes: list[int] = []
    candidate = 2
    while len(primes) < width:
        if all(candidate % p for p in primes):
            primes.append(candidate)
        candidate += 1
    row = frame.sparkSession.createDataFrame([(Vectors.dense([float(p) for p in primes]),)], ["x"])
    terms = PolynomialExpansion(degree=degree, inputCol="x", outputCol="y").transform(row).first().y.toArray()
    weights = []
    for term in terms:
        left, powers = round(term), []
        for p in primes:
            power = 0
            while left % p == 0:
                left, power = left // p, power + 1
            powers.append(power)
        ways = math.factorial(degree) // math.prod(math.factorial(x) for x in powers)
        weights.append(math.sqrt(ways * gamma**degree) if sum(powers) == degree else 0.0)
    return np.array(weights)


class KernelFeatures(Estimator, HasInputCol, HasOutputCol, DefaultParamsWritable, DefaultParamsReadable):
    kernel = Param(Params._dummy(), "kernel", "poly or rbf", typeConverter=TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "of the random features", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, kernel: str = "rbf", seed: int = 1, inputCol: str = "features", outputCol: str = "mapped"):
        super().__init__()
        self._setDefault(kernel="rbf", seed=1, inputCol="features", outputCol="mapped")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        width, gamma = scale(dataset, self.getInputCol())
        out = self.getOutputCol()
        if self.getOrDefault("kernel") == "poly":
            weights = monomial_weights(dataset, width, DEGREE, gamma)
            terms = PolynomialExpansion(degree=DEGREE, inputCol=self.getInputCol(), outputCol=f"{out}_terms")
            return PipelineModel([terms, ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=f"{out}_terms", outputCol=out)])
        if self.getOrDefault("kernel") != "rbf":
            raise ValueError(f"kernel must be poly or rbf, got {self.getOrDefault('kernel')!r}")
        rng = np.random.default_rng(self.getOrDefault("seed"))
        waves = rng.normal(size=(width, FOURIER_FEATURES)) * math.sqrt(2 * gamma)
        return self._copyValues(FourierFeatures(waves, rng.uniform(0, 2 * math.pi, FOURIER_FEATURES)))


class FourierFeatures(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """sqrt(2 / n) cos(x W + b) for random waves W and shifts b."""

    def __init__(self, waves: np.ndarray | None = None, shifts: np.ndarray | None = None):
        super().__init__()
        self.waves, self.shifts = waves, shifts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.waves, self.shifts))

        @F.arrow_udf("array<double>")
        def mapped(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            waves, shifts = shared.value
            for column in columns:
                rows = column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, len(waves)))
                out = np.sqrt(2 / len(shifts)) * np.cos(rows @ waves + shifts)
                ends = pa.array(np.arange(len(out) + 1) * len(shifts), pa.int32())
                yield pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: FourierFeatures):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        held = json.dumps([self.model.waves.tolist(), self.model.shifts.tolist()])
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"held": held})


class _Reader(MLReader):
    def load(self, path: str) -> FourierFeatures:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        waves, shifts = json.loads(metadata["held"])
        model = FourierFeatures(np.array(waves), np.array(shifts))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
