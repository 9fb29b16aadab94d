"""Decision trees with exact thresholds, grown for many training sets at once.

All trees of a search (every criterion, every fold left out, and all rows) grow
together, one level per round.  A round counts the classes by (tree, node,
feature, value) in Spark, turns them into prefix counts over the sorted
different values, and keeps the best threshold of each node.  Prefix counts are
sums within a bucket of neighbouring values on top of sums over whole buckets,
so no task sorts all values of a feature.  Every threshold between two different
values of a node is tried.  The driver holds the trees, of which a level has at
most two to the power of its depth nodes.

As each node keeps its class counts, a tree cut at a smaller depth is the tree
of that depth, so one growth answers every depth of a grid.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window, functions as F

from .nearest import _vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CRITERIA = ("gini", "entropy")
# Different values of a feature that a task sorts, about.
BUCKET_VALUES = 100_000
# Digits to which scores of thresholds are compared, so that engines agree on ties.
DIGITS = 6


@dataclass
class Tree:
    """Nodes in the order in which they were made; ``left`` is -1 in leaves and the right child follows the left one."""

    criterion: str
    fold: int  # the fold that its training rows leave out; -1 for none
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)

    def add(self, depth: int, counts: list[int]) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.depth.append(depth)
        self.counts.append(counts)
        return len(self.left) - 1

    def arrays(self) -> tuple:
        return self.fold, np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.depth)

    def label(self) -> np.ndarray:
        """The commonest class of each node, the smallest on ties."""
        return np.array(self.counts).argmax(axis=1)


def _nodes(rows: np.ndarray, feature, threshold, left, depth, most: int) -> np.ndarray:
    """The node that each row ends in, at a depth of ``most`` at the latest."""
    at = np.zeros(len(rows), np.int64)
    while True:
        go = np.flatnonzero((left[at] >= 0) & (depth[at] < most))
        if not len(go):
            return at
        here = at[go]
        at[go] = left[here] + (rows[go, feature[here]] > threshold[here])


def _level(data: DataFrame, trees: list[Tree], is_open: list[np.ndarray], edges: list[np.ndarray], classes: int) -> DataFrame:
    """Class counts (c0, c1, ...) by tree, node, feature, bucket and value in the open nodes."""
    shared = data.sparkSession.sparkContext.broadcast(([t.arrays() for t in trees], is_open, edges))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, is_open, edges = shared.value
        for batch in batches:
            if not len(batch):
                continue
            rows, label, fold = _vectors(batch.column(0)), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            for t, (left_out, *parts) in enumerate(grown):
                if not is_open[t].any():
                    continue
                at = _nodes(rows, *parts, 1 << 30)
                mine = np.flatnonzero((fold != left_out) & is_open[t][at])
                if not len(mine):
                    continue
                for j in range(rows.shape[1]):
                    value = rows[mine, j]
                    kinds, place = np.unique(value, return_inverse=True)
                    key, n = np.unique((at[mine] * len(kinds) + place) * classes + label[mine], return_counts=True)
                    own = kinds[key // classes % len(kinds)]
                    columns = [np.full(len(key), t), key // classes // len(kinds), np.full(len(key), j), np.searchsorted(edges[j], own, "right"), own, key % classes, n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "feature", "bucket", "value", "label", "n"])

    found = data.select("vector", "label", "fold").mapInArrow(count, "tree long, node long, feature long, bucket long, value double, label long, n long")
    of_class = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(classes)]
    return found.groupBy("tree", "node", "feature", "bucket", "value").agg(*of_class)


def _impurity(criterion: str, counts: list, n):
    """Impurity of a node times its rows, up to terms that no threshold changes."""
    if criterion == "gini":
        return -sum((c * c for c in counts[1:]), counts[0] * counts[0]) / n
    log = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    return n * F.log(n) - sum((log(c) for c in counts[1:]), log(counts[0]))


def best_splits(counted: DataFrame, trees: list[Tree], classes: int) -> DataFrame:
    """(tree, node, feature, threshold, left class counts) of the threshold with the least impurity in each node.

    The first feature and the lowest threshold win ties.
    """
    names = [f"c{c}" for c in range(classes)]
    node = ["tree", "node", "feature"]
    by_bucket = Window.partitionBy(*node).orderBy("bucket")
    buckets = counted.groupBy(*node, "bucket").agg(*[F.sum(c).alias(c) for c in names], F.min("value").alias("first"))
    buckets = buckets.select(
        *node, "bucket", F.lead("first").over(by_bucket).alias("after"),
        *[F.coalesce(F.sum(c).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{c}") for c in names],
        *[F.sum(c).over(Window.partitionBy(*node)).alias(f"all_{c}") for c in names],
    )
    by_value = Window.partitionBy(*node, "bucket").orderBy("value")
    rows = counted.withColumn("next", F.lead("value").over(by_value))
    rows = rows.withColumns({f"upto_{c}": F.sum(c).over(by_value.rowsBetween(Window.unboundedPreceding, 0)) for c in names})
    rows = rows.join(buckets, [*node, "bucket"]).withColumn("next", F.coalesce("next", "after")).where("next is not null")
    left = [(F.col(f"before_{c}") + F.col(f"upto_{c}")).cast("double") for c in names]
    right = [F.col(f"all_{c}").cast("double") - x for c, x in zip(names, left)]
    score = F.lit(None).cast("double")
    for criterion in {t.criterion for t in trees}:
        own = [i for i, t in enumerate(trees) if t.criterion == criterion]
        both = _impurity(criterion, left, sum(left[1:], left[0])) + _impurity(criterion, right, sum(right[1:], right[0]))
        score = F.when(F.col("tree").isin(own), F.round(both, DIGITS)).otherwise(score)
    middle = (F.col("value") + F.col("next")) / 2
    threshold = F.when(middle < F.col("next"), middle).otherwise(F.col("value"))
    best = F.min(F.struct(score.alias("score"), "feature", threshold.alias("threshold"), F.array(*[x.cast("long") for x in left]).alias("left")))
    return rows.groupBy("tree", "node").agg(best.alias("best")).select("tree", "node", "best.feature", "best.threshold", "best.left")


def bucket_edges(data: DataFrame, width: int, values: int = BUCKET_VALUES) -> list[np.ndarray]:
    """For each feature, values that part its values into buckets of about ``values`` rows."""
    buckets = math.ceil(data.count() / values)
    if buckets < 2:
        return [np.zeros(0)] * width
    shares = [i / buckets for i in range(1, buckets)]
    columns = [F.percentile_approx(F.col("vector")[j], shares, 10 * buckets).alias(f"e{j}") for j in range(width)]
    found = data.agg(*columns).first()
    return [np.unique(np.array(found[f"e{j}"], float)) for j in range(width)]


def grow(data: DataFrame, wanted: list[tuple[str, int]], depth: int, width: int, classes: int, values: int = BUCKET_VALUES) -> list[Tree]:
    """Trees of at most ``depth`` levels for each (criterion, fold left out); ``data`` has vector, label, fold."""
    trees = [Tree(criterion, fold) for criterion, fold in wanted]
    if any(t.criterion not in CRITERIA for t in trees):
        raise ValueError(f"criteria are {CRITERIA}")
    sizes = {(r.fold, int(r.label)): r["count"] for r in data.groupBy("fold", "label").count().collect()}
    for t in trees:
        t.add(0, [sum(n for (f, c), n in sizes.items() if c == k and f != t.fold) for k in range(classes)])
    edges = bucket_edges(data, width, values)
    impure = lambda counts: sum(c > 0 for c in counts) > 1
    for level in range(depth):
        is_open = [np.array([d == level and impure(c) for d, c in zip(t.depth, t.counts)]) for t in trees]
        if not any(x.any() for x in is_open):
            break
        for r in best_splits(_level(data, trees, is_open, edges, classes), trees, classes).orderBy("tree", "node").collect():
            t = trees[r.tree]
            t.feature[r.node], t.threshold[r.node] = int(r.feature), r.threshold
            t.left[r.node] = t.add(level + 1, list(r.left))
            t.add(level + 1, [a - b for a, b in zip(t.counts[r.node], r.left)])
    return trees


def hits(data: DataFrame, trees: list[Tree], depths: list[int]) -> dict[tuple[int, int], float]:
    """Share of the rows left out by each tree that it labels rightly, cut at each depth: {(tree, depth): share}."""
    shared = data.sparkSession.sparkContext.broadcast([(t.arrays(), t.label()) for t in trees])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows, label, fold = _vectors(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            out = []
            for t, ((left_out, *parts), best) in enumerate(shared.value):
                mine = np.flatnonzero(fold == left_out)
                for depth in depths:
                    right = best[_nodes(rows[mine], *parts, depth)] == label[mine]
                    out.append((t, depth, int(right.sum()), len(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["tree", "depth", "hits", "n"])

    found = data.select("vector", "label", "fold").mapInArrow(judge, "tree long, depth long, hits long, n long")
    rows = found.groupBy("tree", "depth").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    return {(r.tree, r.depth): r.hits / r.n if r.n else 0.0 for r in rows}


class _TreeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    criterion = Param(Params._dummy(), "criterion", "gini or entropy", typeConverter=TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest number of levels below the root", typeConverter=TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(criterion="gini", maxDepth=5, featuresCol="features", labelCol="label", predictionCol="prediction")


class ExactTreeClassifier(Estimator, _TreeParams, DefaultParamsWritable, DefaultParamsReadable):
    """A decision tree that tries every threshold between two different values."""

    @keyword_only
    def __init__(self, *, criterion: str = "gini", maxDepth: int = 5, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ExactTreeModel":
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("vector"), F.col(self.getLabelCol()).cast("long").alias("label"), F.lit(0).alias("fold"))
        size = rows.agg(F.max("label").alias("label"), F.max(F.size("vector")).alias("width")).first()
        classes, width = (size.label or 0) + 1, size.width or 0
        tree = grow(rows, [(self.getOrDefault("criterion"), -1)], self.getOrDefault("maxDepth"), width, classes)[0]
        return self._copyValues(ExactTreeModel(tree))


class ExactTreeModel(Model, _TreeParams, MLWritable, MLReadable):
    def __init__(self, tree: Tree | None = None):
        super().__init__()
        self._defaults()
        self.tree = tree

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared, most = dataset.sparkSession.sparkContext.broadcast((self.tree.arrays(), self.tree.label())), self.getOrDefault("maxDepth")

        @F.arrow_udf("double")
        def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            (_, *parts), best = shared.value
            for column in columns:
                yield pa.array(best[_nodes(_vectors(column), *parts, most)].astype(float) if len(column) else [], pa.float64())

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _TreeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreeReader()


class _TreeWriter(MLWriter):
    def __init__(self, model: ExactTreeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        t = self.model.tree
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"grown": json.dumps([t.criterion, t.fold])})
        rows = [(i, *row) for i, row in enumerate(zip(t.feature, t.threshold, t.left, t.depth, t.counts))]
        self.sparkSession.createDataFrame(rows, "node long, feature int, threshold double, left long, depth int, counts array<long>").write.parquet(f"{path}/nodes")


class _TreeReader(MLReader):
    def load(self, path: str) -> ExactTreeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        columns = list(zip(*(tuple(r)[1:] for r in self.sparkSession.read.parquet(f"{path}/nodes").orderBy("node").collect())))
        model = ExactTreeModel(Tree(*json.loads(metadata["grown"]), *[list(c) for c in columns]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
