"""Multilayer perceptrons of many shapes and folds trained at once.

Layers, loss and parameters are those of ``MultilayerPerceptronClassifier``:
sigmoids, then a softmax under the mean cross entropy, from the weights that its
seed gives.  A trained network becomes its model.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from .descent import minimize, row_blocks, solve, summed
from .materialize import release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows computed at a time, whose values stay in a core's cache.
CHUNK = 1024


@dataclass(frozen=True)
class Network:
    layers: tuple[int, ...]
    fold: int  # left out of training; -1 for none
    steps: int = 200
    seed: int = 1


def _affine(layers, weights):
    """(matrix, shift) of each layer; Spark stores an output-by-input matrix by columns, then the shift."""
    out, at = [], 0
    for fan_in, fan_out in zip(layers, layers[1:]):
        matrix = weights[at : at + fan_in * fan_out].reshape(fan_in, fan_out)
        at += fan_in * fan_out
        out.append((matrix, weights[at : at + fan_out]))
        at += fan_out
    return out


def _layers(vectors, affine, room=None):
    """The values of every layer, those of the last one not yet made shares of the classes.

    ``room`` gives an array to write a layer's values to.
    """
    values = [vectors]
    for place, (matrix, shift) in enumerate(affine[:-1]):
        inner = np.matmul(values[-1], -matrix, out=room and room(place, len(vectors), len(shift)))
        inner -= shift
        with np.errstate(over="ignore"):
            np.exp(inner, out=inner)
        inner += 1
        values.append(np.reciprocal(inner, out=inner))
    return [*values, values[-1] @ affine[-1][0] + affine[-1][1]]


def _forward(vectors, affine):
    """The values of every layer, of the last one the shares of the classes."""
    *values, odds = _layers(vectors, affine)
    odds = np.exp(odds - odds.max(axis=1, keepdims=True))
    return [*values, odds / odds.sum(axis=1, keepdims=True)]


def _slopes(vectors, truth, affine, total, room):
    """Add the loss and gradient over the rows to ``total``."""
    values = _layers(vectors, affine, room)
    odds, own = np.ascontiguousarray(values[-1].T), np.arange(len(vectors))
    odds -= odds.max(axis=0)
    chosen = odds[truth, own]
    np.exp(odds, out=odds)
    whole = odds.sum(axis=0)
    total[0] += (np.log(whole) - chosen).sum(dtype=float)
    odds /= whole
    odds[truth, own] -= 1
    error, at, ones = np.ascontiguousarray(odds.T), len(total), np.ones(len(vectors), odds.dtype)
    for place in reversed(range(len(affine))):
        (matrix, shift), before = affine[place], values[place]
        total[at - len(shift) : at] += ones @ error
        at -= len(shift)
        total[at - matrix.size : at] += (before.T @ error).ravel()
        at -= matrix.size
        if place:
            error = np.matmul(error, matrix.T, out=room(-place, len(vectors), len(matrix)))
            # What came before is not needed again: it becomes its own slope.
            error *= before
            np.subtract(1, before, out=before)
            error *= before


def entropy(vectors, label, fold, asked):
    """The loss and gradient of each of the asked (layers, fold left out, weights), one after the other.

    A network is computed in the precision of its weights, and summed in doubles.
    """
    # In the order of their folds, the rows that a network learns from are two slices.
    order, out, rows, rooms = np.argsort(fold, kind="stable"), [], {}, {}
    fold, label = fold[order], label[order]
    for layers, left_out, weights in asked:
        kind = weights.dtype
        if kind not in rows:
            rows[kind] = vectors[order].astype(kind)

        def room(place, n, units):
            if (kind, place, units) not in rooms:
                rooms[kind, place, units] = np.empty((CHUNK, units), kind)
            return rooms[kind, place, units][:n]

        total, affine = np.zeros(len(weights) + 1), _affine(layers, weights)
        for first, last in ((0, np.searchsorted(fold, left_out, "left")), (np.searchsorted(fold, left_out, "right"), len(fold))):
            for i in range(first, last, CHUNK):
                part = slice(i, min(i + CHUNK, last))
                _slopes(rows[kind][part], label[part], affine, total, room)
        out.append(total)
    return np.concatenate(out)


def hits(vectors, label, fold, asked):
    """Rows rightly labelled by each network among those it left out, and their number."""
    out = []
    for layers, left_out, weights in asked:
        mine = fold == left_out
        guess = _forward(vectors[mine], _affine(layers, weights))[-1].argmax(axis=1) if mine.any() else np.zeros(0)
        out += [(guess == label[mine]).sum(), mine.sum()]
    return np.array(out, float)


def model_of(network: Network, data: DataFrame, weights: np.ndarray | None = None):
    """Spark's model with the given weights, or with those it starts from."""
    start = {} if weights is None else {"initialWeights": Vectors.dense(weights)}
    estimator = MultilayerPerceptronClassifier(layers=list(network.layers), maxIter=0, seed=network.seed, **start)
    return estimator.fit(data.select("features", "label"))._set(maxIter=network.steps)


def train(data: DataFrame, networks: list[Network]) -> tuple[list[np.ndarray], list[float]]:
    """Weights of each network, and its accuracy on the fold it leaves out; ``data`` has features, label and fold.

    A network descends in single precision until that gains nothing more, then
    in doubles: only they end a descent before its last step.
    """
    sc = data.sparkSession.sparkContext
    few = data.limit(1)
    start = {key: model_of(Network(key[0], -1, 0, key[1]), few).weights.toArray() for key in {(n.layers, n.seed) for n in networks}}
    rows = {r.fold: r["count"] for r in data.groupBy("fold").count().collect()}
    trained_on = [max(1, sum(c for f, c in rows.items() if f != n.fold)) for n in networks]
    blocks = row_blocks(data.select(vector_to_array("features").alias("vector"), F.col("label").cast("int").alias("label"), "fold"))

    kinds = [np.float32] * len(networks)

    def refined(i: int) -> bool:
        was, kinds[i] = kinds[i], np.float64
        return was is np.float32

    def answer(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        shared = sc.broadcast([(networks[i].layers, networks[i].fold, at.astype(kinds[i])) for i, at in asked.items()])
        total = summed(blocks, entropy, shared, sum(len(at) + 1 for at in asked.values()))
        shared.destroy()
        found, place = {}, 0
        for i, at in asked.items():
            mean = total[place : place + len(at) + 1] / trained_on[i]
            found[i] = (float(mean[0]), mean[1:])
            place += len(at) + 1
        return found

    try:
        weights = solve([minimize(start[n.layers, n.seed], n.steps, again=partial(refined, i)) for i, n in enumerate(networks)], answer)
        shared = sc.broadcast([(n.layers, n.fold, w) for n, w in zip(networks, weights)])
        right = summed(blocks, hits, shared, 2 * len(networks)).reshape(-1, 2)
        shared.destroy()
    finally:
        release(blocks)
    return weights, [float(h / n) if n else 0.0 for h, n in right]
