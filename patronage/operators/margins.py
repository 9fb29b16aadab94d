"""Linear support-vector machines, one against the rest, of many penalties and folds at once.

The loss is that of ``LinearSVC`` without standardization: the mean hinge loss and
half of ``regParam`` times the squared coefficients, intercept apart.  Features
are centred and scaled for the descent alone.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from .descent import minimize, row_blocks, solve, summed
from .materialize import release

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Machine:
    penalty: float  # LinearSVC's regParam
    fold: int  # left out of training; -1 for none
    steps: int = 100


def hinge(vectors, label, fold, asked):
    """Losses, gradients and intercept gradients of the asked (classes, folds left out, coefficients, intercepts)."""
    of, out, coefficients, intercepts = asked
    sign = np.where(label[:, None] == of, 1.0, -1.0)
    short = 1 - sign * (vectors @ coefficients.T + intercepts)
    inside = (short > 0) & (fold[:, None] != out)
    pull = np.where(inside, -sign, 0.0)
    return np.concatenate([np.where(inside, short, 0.0).sum(axis=0), (pull.T @ vectors).ravel(), pull.sum(axis=0)])


def hits(vectors, label, fold, machines):
    """Rows rightly labelled by each machine among those it left out, and their number."""
    out = []
    for left_out, coefficients, intercepts in machines:
        mine = fold == left_out
        guess = (vectors[mine] @ coefficients.T + intercepts).argmax(axis=1) if mine.any() else np.zeros(0)
        out += [(guess == label[mine]).sum(), mine.sum()]
    return np.array(out, float)


def scales(data: DataFrame, folds: set[int]) -> dict[int, tuple]:
    """(rows, means, standard deviations) of the rows outside of each fold."""
    summary = Summarizer.metrics("count", "sum", "normL2").summary(F.col("features")).alias("of")
    by_fold = {r.fold: (r.of["count"], np.array(r.of["sum"]), np.array(r.of["normL2"]) ** 2) for r in data.groupBy("fold").agg(summary).collect()}
    width = max((len(v[1]) for v in by_fold.values()), default=0)
    found = {}
    for fold in folds:
        n, total, square = 0, np.zeros(width), np.zeros(width)
        for f, (rows, s, q) in by_fold.items():
            if f != fold:
                n, total, square = n + rows, total + s, square + q
        mean = total / max(n, 1)
        variance = (square - n * mean**2) / max(n - 1, 1)
        found[fold] = (n, mean, np.sqrt(np.where(variance > 1e-14 * np.maximum(square / max(n, 1), 1e-300), variance, 0.0)))
    return found


def accuracies(data: DataFrame, machines: list[Machine], classes: int) -> list[float]:
    """Accuracy of each machine on the fold it leaves out; ``data`` has features, label and fold."""
    sc = data.sparkSession.sparkContext
    of_fold = scales(data, {m.fold for m in machines})
    blocks = row_blocks(data.select(vector_to_array("features").alias("vector"), F.col("label").cast("int").alias("label"), "fold"))
    wanted = [(m, c) for m in machines for c in range(classes)]

    def plain(m: Machine, at: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients and intercept for features as they are; a constant feature has none."""
        _, mean, spread = of_fold[m.fold]
        coefficients = np.divide(at[:-1], spread, out=np.zeros(len(spread)), where=spread > 0)
        return coefficients, at[-1] - mean @ coefficients

    def answer(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        points = [plain(wanted[i][0], at) for i, at in asked.items()]
        n, width = len(asked), len(points[0][0])
        shared = sc.broadcast((np.array([wanted[i][1] for i in asked]), np.array([wanted[i][0].fold for i in asked]), np.array([p[0] for p in points]), np.array([p[1] for p in points])))
        total = summed(blocks, hinge, shared, n * (width + 2))
        shared.destroy()
        losses, gradients, pulls = total[:n], total[n : n + n * width].reshape(n, width), total[n + n * width :]
        found = {}
        for j, i in enumerate(asked):
            m, (coefficients, _) = wanted[i][0], points[j]
            rows, mean, spread = of_fold[m.fold]
            rows = max(rows, 1)
            slope = gradients[j] / rows + m.penalty * coefficients - mean * pulls[j] / rows
            slope = np.divide(slope, spread, out=np.zeros(width), where=spread > 0)
            found[i] = (losses[j] / rows + m.penalty / 2 * coefficients @ coefficients, np.append(slope, pulls[j] / rows))
        return found

    try:
        width = max((len(mean) for _, mean, _ in of_fold.values()), default=0)
        fitted = [plain(m, at) for (m, _), at in zip(wanted, solve([minimize(np.zeros(width + 1), m.steps) for m, _ in wanted], answer))]
        trained = []
        for i, m in enumerate(machines):
            own = fitted[i * classes : (i + 1) * classes]
            trained.append((m.fold, np.array([c for c, _ in own]), np.array([b for _, b in own])))
        shared = sc.broadcast(trained)
        right = summed(blocks, hits, shared, 2 * len(machines)).reshape(-1, 2)
        shared.destroy()
    finally:
        release(blocks)
    return [float(h / n) if n else 0.0 for h, n in right]
