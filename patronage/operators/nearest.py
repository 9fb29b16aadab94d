"""Exact k-nearest-neighbour classification as a pruned join of blocks.

Training points are reduced to their different (vector, label) pairs with
multiplicities and dealt into cells, each around the pivot that is nearest (a
Voronoi partitioning).  A cell is stored in blocks of about ``blockRows`` points.
Different vectors to be classified first meet the blocks of their own cell, which
gives each a bound on its k-th distance, and then only those cells which the
triangle inequality cannot rule out.  A task sees one block of vectors and one
block of points at a time; what it finds is merged as the k smallest by
(distance, label).  The driver holds the pivots and one row per cell, of which
there are ``mostPivots`` at most; nothing else is collected and no row is left out.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window, functions as F

from .materialize import cut, materialize, release

# What runs in tasks is sent by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
MOST_PIVOTS = 2048
# Vectors to be classified in a block, and how many of them are compared at a time.
QUERY_BLOCK, QUERY_ROWS = 1024, 128
# A cell is ruled out only if it is farther than the bound by more than rounding can explain.
SLACK = 1e-9


class _NearestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours that vote", typeConverter=TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "different training points in a block, about", typeConverter=TypeConverters.toInt)
    mostPivots = Param(Params._dummy(), "mostPivots", "largest number of cells", typeConverter=TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(k=5, blockRows=BLOCK_ROWS, mostPivots=MOST_PIVOTS, featuresCol="features", labelCol="label", predictionCol="prediction")


class NearestNeighbors(Estimator, _NearestParams, DefaultParamsWritable, DefaultParamsReadable):
    """The commonest label of the k nearest training rows, the smallest on ties; of equally distant rows those with the lower label are nearer."""

    @keyword_only
    def __init__(self, *, k: int = 5, blockRows: int = BLOCK_ROWS, mostPivots: int = MOST_PIVOTS, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "NearestNeighborsModel":
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("vector"), F.col(self.getLabelCol()).cast("double").alias("label"))
        points = cut(rows.groupBy("vector", "label").agg(F.count("*").alias("n")))
        size, most = self.getOrDefault("blockRows"), self.getOrDefault("mostPivots")
        kinds = points.count()
        wanted = max(1, min(most, math.ceil(kinds / size)))
        order = [F.xxhash64("vector"), "vector"]
        chosen = points.select("vector").distinct().orderBy(*order).limit(wanted).collect() if wanted > 1 else points.select("vector").limit(1).collect()
        pivots = _matrix([r.vector for r in chosen])
        placed = cut(in_cells(points, pivots))
        cells = placed.groupBy("cell").agg(F.count("*").alias("points"), F.sum("n").alias("rows"), F.min("away").alias("low"), F.max("away").alias("high")).orderBy("cell").collect()
        blocks = {r.cell: math.ceil(r.points / size) for r in cells}
        block = F.pmod(F.xxhash64("vector", "label"), _by_cell(blocks, "cell")).cast("int")
        packed = placed.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("vector", "label", "n")).alias("points"))
        model = NearestNeighborsModel(materialize(packed), pivots, [(r.cell, r.rows, r.low, r.high, blocks[r.cell]) for r in cells])
        return self._copyValues(model)


class NearestNeighborsModel(Model, _NearestParams, MLWritable, MLReadable):
    """``packed`` has the points by cell and block; ``cells`` has (cell, rows, least and largest distance from the pivot, blocks)."""

    def __init__(self, packed: DataFrame | None = None, pivots: np.ndarray | None = None, cells: list[tuple] | None = None):
        super().__init__()
        self._defaults()
        self.packed, self.pivots, self.cells = packed, pivots, cells

    def neighbors(self, dataset: DataFrame, k: int | None = None) -> DataFrame:
        """(vector, distance, label, n) of the points nearest to each different vector, at least ``k`` rows by ``n``; distances are squared."""
        k = k or self.getOrDefault("k")
        queries = dataset.select(vector_to_array(self.getFeaturesCol()).alias("vector")).where("vector is not null").distinct()
        if not self.cells:
            return queries.select("vector", F.lit(0.0).alias("distance"), F.lit(0.0).alias("label"), F.lit(0).cast("long").alias("n")).limit(0)
        if len(self.cells) == 1:
            home = queries.select(F.lit(self.cells[0][0]).alias("cell"), "vector", F.lit(math.inf).alias("bound"))
            return nearest_rows(self._met(home, k), k)
        queries = cut(at_home(queries, self.pivots, self.cells, k))
        first = cut(nearest_rows(self._met(queries, k), k))
        # The bound of each vector: the distance by which its own cell has k rows.
        upto = F.sum("n").over(Window.partitionBy("vector").orderBy("distance", "label").rowsBetween(Window.unboundedPreceding, 0))
        reached = first.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("vector").agg(F.sqrt(F.min("distance")).alias("reached"))
        bounded = queries.join(reached, "vector", "left").select("cell", "vector", F.least("bound", F.coalesce("reached", F.lit(math.inf))).alias("bound"))
        others = elsewhere(bounded, self.pivots, self.cells)
        return nearest_rows(first.unionByName(self._met(others, k)), k)

    def votes(self, found: DataFrame, k: int) -> DataFrame:
        """(vector, prediction) from at least ``k`` neighbours of each vector."""
        order = Window.partitionBy("vector").orderBy("distance", "label")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        taken = found.withColumn("taken", F.least("n", F.lit(k) - before)).where("taken > 0")
        counted = taken.groupBy("vector", "label").agg(F.sum("taken").alias("votes"))
        # The commonest, the smallest on ties.
        best = counted.groupBy("vector").agg(F.max(F.struct("votes", (-F.col("label")).alias("minus"))).alias("best"))
        return best.select("vector", (F.lit(0.0) - F.col("best.minus")).alias("prediction"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k = self.getOrDefault("k")
        predicted = self.votes(self.neighbors(dataset, k), k).select(F.col("vector").alias("__vector"), F.col("prediction").alias("__prediction"))
        keyed = dataset.withColumn("__vector", vector_to_array(self.getFeaturesCol()))
        joined = keyed.join(predicted, "__vector", "left")
        return joined.select(*[f"`{c}`" for c in dataset.columns], F.col("__prediction").alias(self.getPredictionCol()))

    def close(self) -> None:
        """Free the blocks if they are persisted; the model cannot be used afterwards."""
        release(self.packed)

    def _met(self, queries: DataFrame, k: int) -> DataFrame:
        """What each vector finds in the blocks of the cells it is sent to; ``queries`` has cell, vector, bound."""
        queries = cut(queries)
        counts = {r.cell: r["count"] for r in queries.groupBy("cell").count().collect()}
        parts = {c: math.ceil(n / QUERY_BLOCK) for c, n in counts.items()}
        part = F.pmod(F.xxhash64("vector"), _by_cell(parts, "cell"))
        asked = queries.groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("vector", "bound")).alias("queries"))
        numbers = F.sequence(F.lit(0), (_by_cell({c[0]: c[4] for c in self.cells}, "cell") - 1).cast("int"))
        asked = asked.withColumn("block", F.explode(numbers))
        return closest(asked.join(self.packed, ["cell", "block"]), k)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: NearestNeighborsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        held = {"pivots": model.pivots.tolist(), "cells": [list(c) for c in model.cells]}
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, extraMetadata={"held": json.dumps(held)})
        model.packed.write.parquet(f"{path}/packed")


class _ModelReader(MLReader):
    def load(self, path: str) -> NearestNeighborsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        held = json.loads(metadata["held"])
        cells = [tuple(c) for c in held["cells"]]
        model = NearestNeighborsModel(self.sparkSession.read.parquet(f"{path}/packed"), _matrix(held["pivots"]), cells)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _by_cell(numbers: dict[int, int], column: str):
    """The number that belongs to the cell of each row; at least one."""
    if len(set(numbers.values())) <= 1:
        return F.lit(next(iter(numbers.values()), 1))
    pairs = [x for c, n in numbers.items() for x in (F.lit(c), F.lit(n))]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(1))


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, float).reshape(len(rows), len(rows[0]) if rows else 0)


def _vectors(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances; one feature after the other, so that equal distances are equal in every block."""
    out = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        out += (queries[:, j, None] - points[None, :, j]) ** 2
    return out


def _squared_pairs(queries: np.ndarray, points: np.ndarray, row: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The same distances, of single pairs."""
    out = np.zeros(len(row))
    for j in range(points.shape[1]):
        out += (queries[row, j] - points[point, j]) ** 2
    return out


def _about(queries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a product of matrices, and how far they may be off."""
    of_queries, of_points = (queries**2).sum(axis=1), (points**2).sum(axis=1)
    doubt = 1e-14 * (points.shape[1] + 8) * (of_queries.max(initial=0.0) + of_points.max(initial=0.0))
    if not np.isfinite(doubt):
        return _squared(queries, points), 0.0
    away = queries @ points.T
    away *= -2
    away += of_queries[:, None]
    away += of_points
    return away, doubt


def _candidates(queries: np.ndarray, points: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) among which are the k nearest points of each query, and all as near as the k-th, as far as they lie within ``most``.

    The bound of the rounding is granted to every pair; few are left to be
    measured exactly.
    """
    away, doubt = _about(queries, points)
    limit = most + doubt
    inside = away <= limit[:, None]
    many = np.flatnonzero(inside.sum(axis=1) > 4 * k)
    if len(many) and len(points) > k:
        kth = np.partition(away[many], k - 1, axis=1)[:, k - 1] + 2 * doubt
        inside[many] = away[many] <= np.minimum(limit[many], kth)[:, None]
    return np.nonzero(inside)


def in_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The points with the cell of their nearest pivot (the first of equals) and the distance from it."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors, cell, own = _vectors(batch.column(0)), [], []
            for i in range(0, len(batch), QUERY_ROWS):
                part = vectors[i : i + QUERY_ROWS]
                row, pivot = _candidates(part, shared.value, np.full(len(part), np.inf), 1)
                away = _squared_pairs(part, shared.value, row, pivot)
                order = np.lexsort((pivot, away, row))
                first = order[np.searchsorted(row[order], np.arange(len(part)))]
                cell.append(pivot[first])
                own.append(np.sqrt(away[first]))
            cell, own = np.concatenate(cell), np.concatenate(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(own)], names=["vector", "label", "n", "cell", "away"])

    return points.select("vector", "label", "n").mapInArrow(place, "vector array<double>, label double, n long, cell int, away double")


def at_home(queries: DataFrame, pivots: np.ndarray, cells: list[tuple], k: int) -> DataFrame:
    """(cell, vector, bound): the cell of the nearest pivot, and a distance within which k rows are sure to be."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = shared.value
        number = np.array([c[0] for c in cells])
        rows, high = np.array([c[1] for c in cells]), np.array([c[3] for c in cells])
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                away, doubt = _about(_vectors(part.column(0)), pivots[number])
                reach = np.sqrt(np.maximum(away + doubt, 0)) + high
                # Every cell has a row, so the k of the least reach are enough.
                few = min(k, len(cells))
                order = np.argpartition(reach, few - 1, axis=1)[:, :few]
                order = np.take_along_axis(order, np.take_along_axis(reach, order, axis=1).argsort(axis=1), axis=1)
                held = np.cumsum(rows[order], axis=1)
                # A whole cell lies within its pivot's distance and its radius.
                enough = np.minimum((held < k).sum(axis=1), few - 1)
                bound = np.take_along_axis(reach, order, axis=1)[np.arange(len(away)), enough]
                bound = np.where(held[:, -1] < k, np.inf, bound * (1 + 1e-9))
                yield pa.RecordBatch.from_arrays([pa.array(number[away.argmin(axis=1)].astype(np.int32)), part.column(0), pa.array(bound)], names=["cell", "vector", "bound"])

    return queries.select("vector").mapInArrow(place, "cell int, vector array<double>, bound double")


def elsewhere(queries: DataFrame, pivots: np.ndarray, cells: list[tuple]) -> DataFrame:
    """The rows (cell, vector, bound) once for every other cell that may have a point within the bound."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = shared.value
        number = np.array([c[0] for c in cells])
        low, high = np.array([c[2] for c in cells]), np.array([c[3] for c in cells])
        at = pivots[number]
        apart = np.sqrt(_squared(at, at))
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                own = np.searchsorted(number, part.column(0).to_numpy())
                points, bound = _vectors(part.column(1)), part.column(2).to_numpy()
                squares, doubt = _about(points, at)
                least, most = np.sqrt(np.maximum(squares - doubt, 0)), np.sqrt(np.maximum(squares + doubt, 0))
                limit = bound * (1 + SLACK) + SLACK * (1 + most.max(axis=1))
                limit = limit[:, None]
                home = np.take_along_axis(squares, own[:, None], axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    # Points of a cell are on its side of the plane between its pivot and the home pivot.
                    plane = (squares - home - 2 * doubt) / (2 * apart[own])
                may = (least - high <= limit) & (low - most <= limit) & ~(plane > limit)
                may[np.arange(len(own)), own] = False
                row, cell = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([pa.array(number[cell].astype(np.int32)), _lists(points[row]), pa.array(bound[row])], names=["cell", "vector", "bound"])

    return queries.select("cell", "vector", "bound").mapInArrow(place, "cell int, vector array<double>, bound double")


def closest(pairs: DataFrame, k: int) -> DataFrame:
    """(vector, distance, label, n): the k nearest points of each block to each vector it meets, within the vector's bound."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked, held = batch.column(0)[i].values, batch.column(1)[i].values
                queries, bound = _vectors(asked.field(0)), asked.field(1).to_numpy(zero_copy_only=False)
                points, labels, n = _vectors(held.field(0)), held.field(1).to_numpy(), held.field(2).to_numpy()
                by_label = np.argsort(labels, kind="stable")
                points, labels, n = points[by_label], labels[by_label], n[by_label]
                for at in range(0, len(queries), QUERY_ROWS):
                    part = queries[at : at + QUERY_ROWS]
                    own = bound[at : at + QUERY_ROWS] * (1 + SLACK) + SLACK
                    row, point = _candidates(part, points, own * own, k)
                    found = _squared_pairs(part, points, row, point)
                    near = found <= (own * own)[row]
                    row, point, found = row[near], point[near], found[near]
                    order = np.lexsort((labels[point], found, row))
                    row, point, found = row[order], point[order], found[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = place < k
                    row, point, found = row[keep], point[keep], found[keep]
                    yield pa.RecordBatch.from_arrays([_lists(part[row]), pa.array(found), pa.array(labels[point]), pa.array(n[point])], names=["vector", "distance", "label", "n"])

    return pairs.select("queries", "points").mapInArrow(find, "vector array<double>, distance double, label double, n long")


def nearest_rows(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each vector by (distance, label)."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("distance", "label"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")
