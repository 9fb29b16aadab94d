"""Gradient-boosted trees for several classes, trained for many settings and folds at once.

Features are binned once, by at most BINS bins each; those of few bins share a
column, whose cells are their combinations.  The binned rows are kept in blocks of
one fold together with the margins that every ensemble (a learning rate and depth,
with one fold left out, or none) gives every class.  A round adds one tree per
class to every ensemble; all trees of the round grow together, one level per
job: tasks turn the margins into gradients of the softmax loss and add up
gradient histograms of all ensembles, classes and open nodes; a node's histograms
meet in one task, which finds its best split.  Gradients are fixed-point integers, so
sums do not depend on the partitioning.  Splits are second order: the gain of
G^2 / (H + lambda), leaves of -G / (H + lambda), and a least hessian per child.

More rounds extend the same ensembles, so an ensemble of fewer rounds is a
prefix.  The driver holds the trees and never a row.
"""

from __future__ import annotations

import json
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
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from .materialize import materialize, release, spread
from .nearest import _vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256
# Penalty of leaf weights, least sum of hessians in a child, least gain of a split.
PENALTY, LEAST_HESSIAN, LEAST_GAIN = 1.0, 1.0, 1e-6
# Gradients are multiples of one part in so many.
UNIT = 1 << 20
# Most cells of a column that features share.
SHARED_CELLS = 64
# Bytes of a level's histograms that the driver keeps at most, so that of two children one is counted.
KEPT_BYTES = 1 << 26
# Rows of a block, and rounds after which the margins are stored anew.
BLOCK_ROWS, KEPT_ROUNDS = 16384, 2


@dataclass
class Boosted:
    """One tree: ``left`` is -1 in leaves, the right child follows the left one, values up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    weight: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, weights: tuple[float, float]) -> list[int]:
        first = len(self.left)
        self.feature[node], self.bin[node], self.left[node] = feature, at, first
        for w in weights:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.weight.append(w)
        return [first, first + 1]

    def arrays(self) -> tuple:
        return np.array(self.feature), np.array(self.bin), np.array(self.left), np.array(self.weight)


@dataclass
class Ensemble:
    rate: float
    depth: int
    fold: int  # left out of training; -1 for none
    rounds: list[list[Boosted]] = field(default_factory=list)


def _leaves(bins: np.ndarray, feature, at_bin, left, _weight) -> np.ndarray:
    """The leaf of each row; every leaf stands for its own left child, which no value passes."""
    at = np.zeros(len(bins), np.int64)
    if left[0] < 0:
        return at
    inner = left >= 0
    own_feature, child = np.where(inner, feature, 0), np.where(inner, left, np.arange(len(left)))
    most = np.iinfo(np.int64).max if at_bin.dtype.kind == "i" else np.inf
    limit = np.where(inner, at_bin, most)
    cells, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    while inner[at].any():
        at = child[at] + (cells[first + own_feature[at]] > limit[at])
    return at


def bin_edges(data: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending edges of each feature; a value is in the bin of the first edge that is not below it.

    Few different values get a bin each, more are parted at their quantiles.
    """
    cells = data.select(F.posexplode("vector").alias("feature", "value")).groupBy("feature", "value").agg(F.count("*").alias("n"))
    few = cells.groupBy("feature").agg(F.count("*").alias("kinds")).where(F.col("kinds") <= bins).select("feature")
    single = {r.feature: r["values"] for r in cells.join(F.broadcast(few), "feature").groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()}
    many = [j for j in range(width) if j not in single]
    shares = [i / bins for i in range(1, bins)]
    found = data.agg(*[F.percentile_approx(F.col("vector")[j], shares, 20 * bins).alias(f"e{j}") for j in many]).first() if many else {}
    edges = []
    for j in range(width):
        values = np.array(single[j] if j in single else found[f"e{j}"], float)
        edges.append((values[1:] + values[:-1]) / 2 if j in single else np.unique(values))
    return edges


def columns_of(kinds: list[int]) -> list[list[tuple[int, int]]]:
    """(feature, stride) of the features of each column; ``kinds`` are the bins of each feature.

    A column's cell is the sum of its features' bins, each times its stride.
    """
    columns, sizes = [], []
    for j in sorted(range(len(kinds)), key=lambda j: -kinds[j]):
        for at, size in enumerate(sizes):
            if size * kinds[j] <= SHARED_CELLS:
                columns[at].append((j, size))
                sizes[at] *= kinds[j]
                break
        else:
            columns.append([(j, 1)])
            sizes.append(kinds[j])
    return columns


def _sizes(columns: list, kinds: list[int]) -> list[int]:
    """Cells of each column."""
    return [column[-1][1] * kinds[column[-1][0]] for column in columns]


def blocks(data: DataFrame, edges: list[np.ndarray], slots: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``data`` (vector, label, fold) as blocks of one fold: n, bins (cells by column), label, fold, margins (one per slot and row, all zero)."""
    columns = columns_of([len(e) + 1 for e in edges])

    def block(fold: int, cells: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        n = len(label)
        held = [np.ascontiguousarray(cells), label, np.zeros((slots, n), "<f4")]
        bins, label, margins = (pa.array([x.tobytes()], pa.binary()) for x in held)
        return pa.RecordBatch.from_arrays([pa.array([n]), bins, label, pa.array([fold], pa.int32()), margins], names=["n", "bins", "label", "fold", "margins"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple] = {}
        for batch in batches:
            vectors = _vectors(batch.column(0))
            binned = [np.searchsorted(e, vectors[:, j], "left") for j, e in enumerate(edges)]
            cells = np.array([sum(binned[j] * stride for j, stride in column) for column in columns], "<u2").reshape(-1, len(batch))
            label, fold = batch.column(1).to_numpy().astype("<i4"), batch.column(2).to_numpy()
            for own in np.unique(fold):
                mine = fold == own
                some = (cells[:, mine], label[mine])
                if own in waiting:
                    some = tuple(np.concatenate(x, axis=-1) for x in zip(waiting[own], some))
                whole = len(some[1]) // rows * rows
                for i in range(0, whole, rows):
                    yield block(int(own), some[0][:, i : i + rows], some[1][i : i + rows])
                waiting[own] = (some[0][:, whole:], some[1][whole:])
        for own, some in waiting.items():
            if len(some[1]):
                yield block(int(own), *some)

    return data.select("vector", "label", "fold").mapInArrow(pack, "n long, bins binary, label binary, fold int, margins binary")


def _unpacked(batch: pa.RecordBatch, classes: int) -> Iterator[tuple]:
    """(cells by column, label, fold, margins by ensemble and class) of each block, read where they lie."""
    for n, bins, label, fold, margins in zip(*batch.columns):
        n, (bins, label, margins) = n.as_py(), (x.as_buffer() for x in (bins, label, margins))
        yield np.frombuffer(bins, "<u2").reshape(-1, n).astype(np.intp), np.frombuffer(label, "<i4"), fold.as_py(), np.frombuffer(margins, "<f4").reshape(-1, classes, n)


def _paths(tree: tuple, columns: list, kinds: list[int]) -> tuple:
    """(levels, column that each node looks at, node that each cell of it leads to, cells of a node); a leaf leads to itself."""
    feature, at_bin, left, _ = tree
    width = max(_sizes(columns, kinds))
    at_column, leads = np.zeros(len(left), np.intp), np.repeat(np.arange(len(left)), width).reshape(-1, width)
    place = {j: (c, stride) for c, column in enumerate(columns) for j, stride in column}
    depth, cells = np.zeros(len(left), int), np.arange(width)
    for node in np.flatnonzero(left >= 0):
        j, child = feature[node], left[node]
        at_column[node], stride = place[j]
        leads[node] = child + (cells // stride % kinds[j] > at_bin[node])
        depth[child : child + 2] = depth[node] + 1
    return int(depth.max()), at_column, leads.ravel(), width


def _ends(cells: np.ndarray, paths: tuple) -> np.ndarray:
    """The node of each row that has no children; ``cells`` are by column."""
    levels, at_column, leads, width = paths
    n = cells.shape[1]
    if not levels:
        return np.zeros(n, np.intp)
    at = leads[:width].take(cells[at_column[0]])
    flat, own, first = cells.ravel(), np.arange(n), at_column * n
    for _ in range(levels - 1):
        where = first.take(at)
        where += own
        at *= width
        at += flat.take(where)
        at = leads.take(at)
    return at


def _advance(margins: np.ndarray, bins: np.ndarray, rounds: list) -> None:
    """Add the trees of later rounds to the margins."""
    for e, (rate, trees) in enumerate(rounds):
        for by_class in trees:
            for c, tree in enumerate(by_class):
                if len(tree[0]) > 1 or tree[3][0]:
                    margins[e, c] += rate * tree[3][_leaves(bins, *tree)]


def _prepared(rounds: list, columns: list, kinds: list[int]) -> list:
    """For each ensemble and later round the (class, paths, what each node adds) of its trees."""
    return [
        [[(c, _paths(t, columns, kinds), (rate * t[3]).astype("f4")) for c, t in enumerate(by_class) if len(t[0]) > 1 or t[3][0]] for by_class in trees]
        for rate, trees in rounds
    ]


def _advanced(margins: np.ndarray, cells: np.ndarray, prepared: list) -> np.ndarray:
    """The margins of one ensemble with the trees of its later rounds added."""
    margins = margins.copy() if any(prepared) else margins
    for by_class in prepared:
        for c, paths, added in by_class:
            margins[c] += added.take(_ends(cells, paths))
    return margins


def _gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the softmax loss of one ensemble, in units, as whole numbers in doubles."""
    p = margins - margins.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    h = 1 - p
    h *= p
    h *= 2 * UNIT
    p[label, np.arange(len(label))] -= 1
    p *= UNIT
    return np.rint(p).astype(float), np.rint(h).astype(float)


def _histograms(state: DataFrame, shared, classes: int, kinds: list[int]) -> DataFrame:
    """(slot, node, cells, g, h) of the open nodes; ``slot`` numbers ensembles and classes, ``kinds`` are the bins of each feature.

    A node's cells are those of all columns one after the other, of which those
    that are not empty are sent.  The broadcast value is (later rounds, trees
    being grown, open nodes, folds left out).
    """
    columns = columns_of(kinds)
    ends = np.cumsum([0, *_sizes(columns, kinds)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, growing, is_open, left_out = shared.value
        later = _prepared(rounds, columns, kinds) or [[] for _ in left_out]
        paths = [[_paths(tree, columns, kinds) if len(nodes) else None for tree, nodes in zip(*x)] for x in zip(growing, is_open)]
        # Sums of whole numbers are exact in doubles.
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for column_cells, label, fold, margins in _unpacked(batch, classes):
                for e, out in enumerate(left_out):
                    if fold == out or not any(len(nodes) for nodes in is_open[e]):
                        continue
                    gradients = _gradients(_advanced(margins[e], column_cells, later[e]), label)
                    for c in range(classes):
                        nodes = is_open[e][c]
                        if not len(nodes):
                            continue
                        node, cells, weights = None, column_cells, [x[c] for x in gradients]
                        if len(growing[e][c][0]) > 1:
                            place = np.full(len(growing[e][c][0]), -1)
                            place[nodes] = np.arange(len(nodes))
                            node = place.take(_ends(column_cells, paths[e][c]))
                            rows = np.flatnonzero(node >= 0)
                            if len(rows) < len(node):
                                node, weights = node.take(rows), [x.take(rows) for x in weights]
                                cells = [x.take(rows) for x in column_cells]
                        if not len(weights[0]):
                            continue
                        if (e, c) not in sums:
                            sums[e, c] = np.zeros((2, len(nodes), ends[-1]))
                        for own, first, last in zip(cells, ends, ends[1:]):
                            size = last - first
                            key = own if node is None else node * size + own
                            for total, weight in zip(sums[e, c], weights):
                                total[:, first:last] += np.bincount(key, weight, len(nodes) * size).reshape(-1, size)
        for (e, c), whole in sums.items():
            out, (g, h) = [], whole.astype(np.int64)
            for i, node in enumerate(is_open[e][c]):
                cells = np.flatnonzero(h[i])
                if len(cells):
                    out.append((e * classes + c, int(node), cells.astype("<i4").tobytes(), g[i, cells].tobytes(), h[i, cells].tobytes()))
            if out:
                kinds_of = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds_of)], names=["slot", "node", "cells", "g", "h"])

    return state.mapInArrow(add_up, "slot long, node long, cells binary, g binary, h binary")


def _splits(histograms: DataFrame, kinds: list[int], parts: int, halves=None, keep: bool = False) -> DataFrame:
    """(slot, node, G, H, and of its best split feature, bin, left G, left H, and its sums if they are to ``keep``); the first feature and lowest bin win ties.

    One exchange deals out the nodes to ``parts`` tasks, each of which adds up what it gets of a node.
    ``halves`` broadcasts {(slot, node): (its sibling, the sums of both)} of the
    nodes whose sibling was not counted: it has what the node lacks.
    """
    columns = columns_of(kinds)
    ends = np.cumsum([0, *_sizes(columns, kinds)])
    place = {j: (ends[c], ends[c + 1], stride) for c, column in enumerate(columns) for j, stride in column}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for slot, node, cells, g, h in zip(*(c.to_pylist() for c in batch.columns)):
                whole = sums.setdefault((slot, node), np.zeros((2, ends[-1]), np.int64))
                whole[:, np.frombuffer(cells, "<i4")] += np.stack([np.frombuffer(g, np.int64), np.frombuffer(h, np.int64)])
        out = []
        for (slot, node), whole in list(sums.items()):
            if halves is not None and (slot, node) in halves.value:
                sibling, both = halves.value[slot, node]
                sums[slot, sibling] = np.frombuffer(both, np.int64).reshape(2, -1) - whole
        for (slot, node), whole in sums.items():
            ag, ah = whole[:, : ends[1]].sum(axis=1) / UNIT
            found = None
            for j, number in enumerate(kinds):
                first, last, stride = place[j]
                lg, lh = np.cumsum(whole[:, first:last].reshape(2, -1, number, stride).sum(axis=(1, 3)), axis=1) / UNIT
                gain = np.round(lg * lg / (lh + PENALTY) + (ag - lg) ** 2 / (ah - lh + PENALTY) - ag * ag / (ah + PENALTY), 9)
                gain[(lh < LEAST_HESSIAN) | (ah - lh < LEAST_HESSIAN) | ~(gain > LEAST_GAIN)] = -np.inf
                at = int(gain.argmax())
                if gain[at] > (found[0] if found else 0.0):
                    found = (gain[at], j, at, lg[at], lh[at])
            out.append((slot, node, ag, ah, *(found[1:] if found else (None,) * 4), whole.tobytes() if found and keep else None))
        if out:
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["slot", "node", "ag", "ah", "feature", "bin", "lg", "lh", "whole"])

    return histograms.repartition(parts, "slot", "node").mapInArrow(best, "slot long, node long, ag double, ah double, feature long, bin long, lg double, lh double, whole binary")


def _leaf(g: float, h: float) -> float:
    return -g / (h + PENALTY)


def train(data: DataFrame, wanted: list[Ensemble], rounds: int, width: int, classes: int, judged: tuple[int, ...] = (), bins: int = BINS, block_rows: int = BLOCK_ROWS) -> tuple[list[np.ndarray], dict[tuple[int, int], float]]:
    """Add ``rounds`` rounds to every new ensemble; the bin edges, and the accuracy on the rows left out.

    ``data`` has vector, label (0, 1, ...) and fold.  The accuracies are
    {(ensemble, rounds): share} for each number of rounds in ``judged``.
    """
    sc = data.sparkSession.sparkContext
    edges = bin_edges(data, width, bins)
    kinds = [len(e) + 1 for e in edges]
    node_bytes = 16 * sum(_sizes(columns_of(kinds), kinds))
    state = materialize(blocks(spread(data.select("vector", "label", "fold")), edges, len(wanted) * classes, block_rows))
    stored, shares = 0, {}
    try:
        for number in range(1, rounds + 1):
            trees = [[Boosted() for _ in range(classes)] for _ in wanted]
            is_open = [[[0] for _ in range(classes)] for _ in wanted]
            later, halves, deepest = _later(wanted, stored), {}, max(e.depth for e in wanted)
            for level in range(deepest):
                frontier = [[np.array(nodes if level < e.depth else [], np.int64) for nodes in is_open[i]] for i, e in enumerate(wanted)]
                if not any(len(nodes) for by_class in frontier for nodes in by_class):
                    break
                nodes = sum(len(open_nodes) for by_class in frontier for open_nodes in by_class)
                left_to_others = {(slot, sibling) for (slot, _), (sibling, _) in halves.items()}
                counted = [[np.array([n for n in own if (i * classes + c, n) not in left_to_others], np.int64) for c, own in enumerate(by_class)] for i, by_class in enumerate(frontier)]
                shared, both = sc.broadcast((later, [[t.arrays() for t in by_class] for by_class in trees], counted, [e.fold for e in wanted])), sc.broadcast(halves)
                is_open, halves = [[[] for _ in range(classes)] for _ in wanted], {}
                keep = level + 1 < deepest and nodes * node_bytes <= KEPT_BYTES
                found = _splits(_histograms(state, shared, classes, kinds), kinds, min(nodes, sc.defaultParallelism), both, keep).collect()
                for r in sorted(found, key=lambda r: (r.slot, r.node)):
                    e, c = divmod(r.slot, classes)
                    tree = trees[e][c]
                    if r.node == 0:
                        tree.weight[0] = _leaf(r.ag, r.ah)
                    if r.feature is not None:
                        # A child can be split again only if both of its own children could have the least hessian.
                        children = tree.split(r.node, r.feature, r.bin, (_leaf(r.lg, r.lh), _leaf(r.ag - r.lg, r.ah - r.lh)))
                        further = [(h, n) for n, h in zip(children, (r.lh, r.ah - r.lh)) if h >= 2 * LEAST_HESSIAN]
                        is_open[e][c] += [n for _, n in further]
                        if len(further) == 2 and r.whole is not None:
                            # The one of the lesser hessian is counted, as a guess at the fewer rows.
                            halves[r.slot, min(further)[1]] = (max(further)[1], bytes(r.whole))
                shared.destroy()
                both.destroy()
            for e, by_class in zip(wanted, trees):
                e.rounds.append(by_class)
            if number in judged:
                for e, share in _judge(state, wanted, stored, classes, kinds).items():
                    shares[e, number] = share
            if number - stored == KEPT_ROUNDS and number < rounds:
                further = materialize(_stored(state, wanted, stored, classes, kinds))
                if further.storageLevel != StorageLevel.NONE:
                    further.count()
                release(state)
                state, stored = further, number
    finally:
        release(state)
    return edges, shares


def _later(wanted: list[Ensemble], stored: int) -> list:
    return [(e.rate, [[t.arrays() for t in by_class] for by_class in e.rounds[stored:]]) for e in wanted]


def _stored(state: DataFrame, wanted: list[Ensemble], stored: int, classes: int, kinds: list[int]) -> DataFrame:
    """The blocks with the margins of all rounds so far."""
    shared, columns = state.sparkSession.sparkContext.broadcast(_later(wanted, stored)), columns_of(kinds)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later = _prepared(shared.value, columns, kinds)
        for batch in batches:
            margins = []
            for cells, _, _, held in _unpacked(batch, classes):
                margins.append(np.stack([_advanced(m, cells, own) for m, own in zip(held, later)]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margins, pa.binary())], names=batch.schema.names)

    return state.mapInArrow(advance, state.schema)


def _judge(state: DataFrame, wanted: list[Ensemble], stored: int, classes: int, kinds: list[int]) -> dict[int, float]:
    """Share of the rows left out by each ensemble that it labels rightly."""
    shared, columns = state.sparkSession.sparkContext.broadcast((_later(wanted, stored), [e.fold for e in wanted])), columns_of(kinds)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, left_out = shared.value
        later = _prepared(rounds, columns, kinds)
        for batch in batches:
            out = []
            for cells, label, fold, margins in _unpacked(batch, classes):
                for e, held in enumerate(left_out):
                    if fold == held:
                        guess = _advanced(margins[e], cells, later[e]).argmax(axis=0)
                        out.append((e, int((guess == label).sum()), len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 3, names=["e", "hits", "n"])

    found = state.mapInArrow(judge, "e long, hits long, n long").groupBy("e").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    return {r.e: r.hits / r.n for r in found if r.n}


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    rate = Param(Params._dummy(), "rate", "learning rate", typeConverter=TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "trees per class", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest number of levels below a root", typeConverter=TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(rate=0.1, rounds=100, maxDepth=5, featuresCol="features", labelCol="label", predictionCol="prediction")


class BoostedTreesClassifier(Estimator, _BoostParams, DefaultParamsWritable, DefaultParamsReadable):
    @keyword_only
    def __init__(self, *, rate: float = 0.1, rounds: int = 100, maxDepth: int = 5, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("vector"), F.col(self.getLabelCol()).cast("int").alias("label"), F.lit(0).alias("fold"))
        size = rows.agg(F.max("label").alias("label"), F.max(F.size("vector")).alias("width")).first()
        own = Ensemble(self.getOrDefault("rate"), self.getOrDefault("maxDepth"), -1)
        edges, _ = train(rows, [own], self.getOrDefault("rounds"), size.width or 0, (size.label or 0) + 1) if size.width else ([], None)
        return self._copyValues(model_of(own, edges))


def model_of(own: Ensemble, edges: list[np.ndarray]) -> "BoostedTreesModel":
    """A model whose trees compare values with thresholds instead of bins."""
    rounds = []
    for by_class in own.rounds:
        row = []
        for t in by_class:
            threshold = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)]
            row.append((list(map(int, t.feature)), threshold, list(map(int, t.left)), list(map(float, t.weight))))
        rounds.append(row)
    return BoostedTreesModel(rounds)


class BoostedTreesModel(Model, _BoostParams, MLWritable, MLReadable):
    """``trees``: for each round and class (features, thresholds, left children, weights); the first ``rounds`` rounds vote."""

    def __init__(self, trees: list | None = None):
        super().__init__()
        self._defaults()
        self.trees = trees or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        arrays = [[tuple(np.array(x) for x in t) for t in by_class] for by_class in self.trees[: self.getOrDefault("rounds")]]
        shared, rate = dataset.sparkSession.sparkContext.broadcast(arrays), self.getOrDefault("rate")

        @F.arrow_udf("double")
        def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            rounds = shared.value
            classes = len(rounds[0]) if rounds else 1
            for column in columns:
                if not len(column):
                    yield pa.array([], pa.float64())
                    continue
                margins = np.zeros((1, classes, len(column)))
                _advance(margins, _vectors(column), [(rate, rounds)])
                yield pa.array(margins[0].argmax(axis=0).astype(float))

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _BoostWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostReader()


class _BoostWriter(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"kind": json.dumps("boosted")})
        rows = [(r, c, *t) for r, by_class in enumerate(self.model.trees) for c, t in enumerate(by_class)]
        kind = "round long, class long, feature array<int>, threshold array<double>, left array<int>, weight array<double>"
        self.sparkSession.createDataFrame(rows, kind).write.parquet(f"{path}/trees")


class _BoostReader(MLReader):
    def load(self, path: str) -> BoostedTreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        trees: list = []
        for r in self.sparkSession.read.parquet(f"{path}/trees").orderBy("round", "class").collect():
            if r["class"] == 0:
                trees.append([])
            trees[-1].append(tuple(list(x) for x in tuple(r)[2:]))
        model = BoostedTreesModel(trees)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
