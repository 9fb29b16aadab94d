"""Gaussian naive Bayes for every fold left out, from one pass of sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

# Variances are raised by this share of the largest one, as the fitted models do.
SMOOTHING = 1e-9


def fold_moments(data: DataFrame) -> dict[int, dict[float, tuple[int, np.ndarray, np.ndarray]]]:
    """{fold: {label: (rows, sums, sums of squares)}}; one row per fold and label reaches the driver."""
    summary = Summarizer.metrics("count", "sum", "normL2").summary(F.col("features")).alias("of")
    out: dict = {}
    for r in data.groupBy("fold", "label").agg(summary).collect():
        out.setdefault(int(r.fold), {})[float(r.label)] = (int(r.of["count"]), np.array(r.of["sum"]), np.array(r.of["normL2"]) ** 2)
    return out


def left_out_model(moments: dict, fold: int) -> list[tuple[float, float, list[float], list[float]]]:
    """(label, constant, means, variances) of each class over the rows of all other folds."""
    classes: dict[float, list] = {}
    for other, by_label in moments.items():
        if other != fold:
            for label, (n, total, square) in by_label.items():
                held = classes.setdefault(label, [0, 0.0, 0.0])
                held[0], held[1], held[2] = held[0] + n, held[1] + total, held[2] + square
    rows = sum(n for n, _, _ in classes.values())
    if not rows:
        return []
    mean = sum(t for _, t, _ in classes.values()) / rows
    spread = sum(s for _, _, s in classes.values()) / rows - mean**2
    least = SMOOTHING * float(spread.max(initial=0.0))
    model = []
    for label, (n, total, square) in sorted(classes.items()):
        mu = total / n
        variance = square / n - mu**2 + least
        constant = math.log(n / rows) - float(np.log(2 * math.pi * variance).sum()) / 2
        model.append((label, constant, mu.tolist(), variance.tolist()))
    return model


def fold_accuracies(data: DataFrame, folds: int) -> list[float]:
    """Accuracy on each fold of the model that the other folds give; ``data`` has features, label, fold.

    One aggregation gathers the sums of every fold and label, and one pass
    scores each row by the model that left its fold out.
    """
    moments = fold_moments(data)
    models = [(fold, left_out_model(moments, fold)) for fold in range(folds)]
    kind = "fold int, classes array<struct<label: double, constant: double, mu: array<double>, variance: array<double>>>"
    # One row per fold.
    of_fold = data.sparkSession.createDataFrame(models, kind)

    def likelihood(c):
        cells = F.zip_with(F.zip_with("vector", c["mu"], lambda x, m: (x - m) * (x - m)), c["variance"], lambda away, v: away / v)
        return F.struct((c["constant"] - F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / 2).alias("score"), (-c["label"]).alias("minus"))

    scored = data.select("fold", "label", vector_to_array("features").alias("vector")).join(F.broadcast(of_fold), "fold")
    best = F.array_max(F.transform("classes", likelihood))
    hit = F.coalesce((best["minus"] == -F.col("label")).cast("double"), F.lit(0.0))
    found = {int(r.fold): r.accuracy for r in scored.groupBy("fold").agg(F.avg(hit).alias("accuracy")).collect()}
    return [found.get(fold, 0.0) for fold in range(folds)]
