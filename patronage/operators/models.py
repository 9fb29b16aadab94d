"""Classifier families, their parameter grids and the cross-validated search."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .bayes import fold_accuracies
from .boosting import BoostedTreesClassifier, Ensemble, model_of, train
from .forests import Forest, ForestClassifier, model_of as forest_model, train as train_forests
from .kernelmaps import KernelFeatures
from .margins import Machine, accuracies
from .materialize import materialize, release
from .nearest import NearestNeighbors
from .perceptron import Network, model_of as network_model, train as train_networks
from .trees import ExactTreeClassifier, ExactTreeModel, grow, hits

# The parameter grid searched for each classifier, in the order
# in which ties between classifiers are decided.
DEFAULT_GRIDS = {
    "logistic_regression": [{"C": 1}, {"C": 5}, {"C": 10}],
    "knn": [{"n_neighbors": 5}, {"n_neighbors": 10}, {"n_neighbors": 15}],
    "naive_bayes": [{}],
    "svc": [{"C": c, "kernel": kernel} for c in (1, 10, 20) for kernel in ("linear", "poly", "rbf")],
    "decision_tree": [
        {"criterion": criterion, "max_depth": depth} for criterion in ("gini", "entropy") for depth in (5, 10, 15)
    ],
    "random_forest": [
        {"n_estimators": trees, "criterion": criterion} for trees in (100, 200, 500) for criterion in ("gini", "entropy")
    ],
    "boosted_trees": [
        {"learning_rate": rate, "n_estimators": trees, "max_depth": depth}
        for rate in (0.1, 0.01)
        for trees in (100, 500)
        for depth in (5, 10)
    ],
    "mlp": [{"hidden_layer_sizes": (32, 128)}, {"hidden_layer_sizes": (64, 128)}],
}
MODERN = ("random_forest", "boosted_trees", "mlp")

# Spark's limit; trees otherwise grow until their leaves are pure.
FOREST_DEPTH = 30
# Candidate thresholds of a feature in forests; a grid point may give its own ``max_bins``.
MAX_BINS = 1024


@dataclass(frozen=True)
class Shape:
    """What an estimator needs to know of its training data."""

    rows: int
    features: int
    classes: int
    seed: int = 1


def _logistic_regression(p, shape):
    # An inverse penalty C on the summed loss is 1 / (C * rows) on the mean loss.
    return LogisticRegression(
        regParam=1 / (p["C"] * shape.rows), standardization=False, maxIter=p.get("max_iter", 100)
    )


def _knn(p, shape):
    return NearestNeighbors(k=p["n_neighbors"])


def _naive_bayes(p, shape):
    return NaiveBayes(modelType="gaussian")


def _svc(p, shape):
    margin = LinearSVC(
        regParam=1 / (p["C"] * shape.rows), standardization=False, maxIter=p.get("max_iter", 100)
    )
    kernel = p.get("kernel", "linear")
    if kernel == "linear":
        return OneVsRest(classifier=margin, parallelism=shape.classes)
    return Pipeline(stages=[KernelFeatures(kernel=kernel, seed=shape.seed), OneVsRest(classifier=margin, featuresCol="mapped")])


def _decision_tree(p, shape):
    return ExactTreeClassifier(criterion=p["criterion"], maxDepth=p["max_depth"])


def _random_forest(p, shape):
    return ForestClassifier(
        numTrees=p["n_estimators"],
        criterion=p["criterion"],
        maxDepth=p.get("max_depth", FOREST_DEPTH),
        maxBins=p.get("max_bins", MAX_BINS),
        seed=shape.seed,
    )


def _boosted_trees(p, shape):
    return BoostedTreesClassifier(rate=p["learning_rate"], rounds=p["n_estimators"], maxDepth=p["max_depth"])


def _mlp(p, shape):
    layers = [shape.features, *p["hidden_layer_sizes"], shape.classes]
    return MultilayerPerceptronClassifier(layers=layers, maxIter=p.get("max_iter", 200), seed=shape.seed)


ESTIMATORS: dict[str, Callable] = {
    "logistic_regression": _logistic_regression,
    "knn": _knn,
    "naive_bayes": _naive_bayes,
    "svc": _svc,
    "decision_tree": _decision_tree,
    "random_forest": _random_forest,
    "boosted_trees": _boosted_trees,
    "mlp": _mlp,
}


def accuracy(predicted: DataFrame) -> float:
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predicted.agg(F.avg(hit)).first()[0] or 0.0


def cross_validate(data: DataFrame, estimator: Callable[[Shape], object], shape: Shape, folds: int) -> float:
    """Mean accuracy over the folds of ``data`` (features, label, fold).

    ``data`` is materialized once and filtered per fold, for every fit alike.
    """
    scores = []
    for fold in range(folds):
        held_out = F.col("fold") == fold
        train = data.filter(~held_out).select("features", "label")
        train_shape = Shape(max(1, shape.rows * (folds - 1) // folds), shape.features, shape.classes, shape.seed)
        model = estimator(train_shape).fit(train)
        scores.append(accuracy(model.transform(data.filter(held_out))))
    return sum(scores) / folds


def _knn_scores(data, grid, shape, folds, parallelism):
    """One join per fold finds the neighbours for the largest k; every k votes among them."""
    most = max(p["n_neighbors"] for p in grid)

    def of_fold(fold):
        train, test = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        model = NearestNeighbors(k=most).fit(train)
        found = materialize(model.neighbors(test))
        asked = materialize(test.groupBy(vector_to_array("features").alias("vector"), "label").agg(F.count("*").alias("rows")))
        shares = []
        for p in grid:
            judged = asked.join(model.votes(found, p["n_neighbors"]), "vector", "left")
            hit = F.sum(F.when(F.col("prediction") == F.col("label"), F.col("rows")).otherwise(0))
            shares.append(judged.agg(hit / F.sum("rows")).first()[0] or 0.0)
        release(found, asked)
        model.close()
        return shares

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        shares = list(pool.map(of_fold, range(folds)))
    return [sum(s[i] for s in shares) / folds for i in range(len(grid))], None


def _bayes_scores(data, grid, shape, folds, parallelism):
    """Sums per fold give the models of all folds left out."""
    return [sum(fold_accuracies(data, folds)) / folds] * len(grid), None


def _tree_scores(data, grid, shape, folds, parallelism):
    """All criteria and folds grow together, to the largest depth; every depth is a cut of the same tree."""
    depth = max(p["max_depth"] for p in grid)
    criteria = list(dict.fromkeys(p["criterion"] for p in grid))
    wanted = [(c, fold) for c in criteria for fold in (*range(folds), -1)]
    rows = materialize(data.select(vector_to_array("features").alias("vector"), F.col("label").cast("long").alias("label"), "fold"))
    trees = grow(rows, wanted, depth, shape.features, shape.classes)
    shares = hits(rows, trees, sorted({p["max_depth"] for p in grid}))
    release(rows)
    scores = [sum(shares.get((t, p["max_depth"]), 0.0) for t, (c, fold) in enumerate(wanted) if c == p["criterion"] and fold >= 0) / folds for p in grid]

    def refit(p):
        model = ExactTreeModel(trees[wanted.index((p["criterion"], -1))])
        return model._set(criterion=p["criterion"], maxDepth=p["max_depth"])

    return scores, refit


def _forest_scores(data, grid, shape, folds, parallelism):
    """All criteria and folds grow together; fewer trees are a prefix of more."""
    rows = materialize(data.select(vector_to_array("features").alias("vector"), F.col("label").cast("int").alias("label"), "fold"))
    kind = lambda p: (p["criterion"], p.get("max_depth", FOREST_DEPTH), p.get("max_bins", MAX_BINS), p["n_estimators"] > 1)
    edges, shares, grown = {}, {}, {}
    for bins in dict.fromkeys(kind(p)[2] for p in grid):
        kinds = [k for k in dict.fromkeys(map(kind, grid)) if k[2] == bins]
        numbers = {k: max(p["n_estimators"] for p in grid if kind(p) == k) for k in kinds}
        wanted = [Forest(k[0], k[1], fold, numbers[k]) for k in kinds for fold in (*range(folds), -1)]
        keys = [(k, fold) for k in kinds for fold in (*range(folds), -1)]
        judged = tuple(sorted({p["n_estimators"] for p in grid}))
        edges[bins], found = train_forests(rows, wanted, shape.features, shape.classes, shape.seed, judged, bins)
        grown |= zip(keys, wanted)
        shares |= {(*keys[i], number): share for (i, number), share in found.items()}
    release(rows)
    scores = [sum(shares.get((kind(p), fold, p["n_estimators"]), 0.0) for fold in range(folds)) / folds for p in grid]

    def refit(p):
        model = forest_model(grown[kind(p), -1], edges[kind(p)[2]], shape.classes)
        return model._set(criterion=p["criterion"], numTrees=p["n_estimators"], maxDepth=kind(p)[1], maxBins=kind(p)[2], seed=shape.seed)

    return scores, refit


def _boosted_scores(data, grid, shape, folds, parallelism):
    """All rates, depths and folds are boosted together; fewer trees are a prefix of more."""
    settings = list(dict.fromkeys((p["learning_rate"], p["max_depth"]) for p in grid))
    wanted = [Ensemble(rate, depth, fold) for rate, depth in settings for fold in (*range(folds), -1)]
    rows = data.select(vector_to_array("features").alias("vector"), F.col("label").cast("int").alias("label"), "fold")
    numbers = tuple(sorted({p["n_estimators"] for p in grid}))
    edges, shares = train(rows, wanted, numbers[-1], shape.features, shape.classes, judged=numbers)
    of = {(e.rate, e.depth, e.fold): i for i, e in enumerate(wanted)}
    scores = [sum(shares.get((of[p["learning_rate"], p["max_depth"], fold], p["n_estimators"]), 0.0) for fold in range(folds)) / folds for p in grid]

    def refit(p):
        model = model_of(wanted[of[p["learning_rate"], p["max_depth"], -1]], edges)
        return model._set(rate=p["learning_rate"], rounds=p["n_estimators"], maxDepth=p["max_depth"])

    return scores, refit


def _svc_scores(data, grid, shape, folds, parallelism):
    """All penalties, classes and folds of the linear points descend together; kernels have features of their own in each fold."""
    rows = max(1, shape.rows * (folds - 1) // folds)
    linear = [i for i, p in enumerate(grid) if p.get("kernel", "linear") == "linear"]
    wanted = [Machine(1 / (grid[i]["C"] * rows), fold, grid[i].get("max_iter", 100)) for i in linear for fold in range(folds)]
    found = accuracies(data, wanted, shape.classes) if wanted else []
    scores = {i: sum(found[at * folds : (at + 1) * folds]) / folds for at, i in enumerate(linear)}
    mapped = [i for i in range(len(grid)) if i not in scores]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scores |= zip(mapped, pool.map(lambda i: cross_validate(data, lambda s: _svc(grid[i], s), shape, folds), mapped))
    return [scores[i] for i in range(len(grid))], None


def _mlp_scores(data, grid, shape, folds, parallelism):
    """All shapes and folds descend together."""
    layers = [(shape.features, *p["hidden_layer_sizes"], shape.classes) for p in grid]
    wanted = [Network(own, fold, p.get("max_iter", 200), shape.seed) for own, p in zip(layers, grid) for fold in (*range(folds), -1)]
    weights, shares = train_networks(data, wanted)
    scores = [sum(shares[i * (folds + 1) : i * (folds + 1) + folds]) / folds for i in range(len(grid))]

    def refit(p):
        last = (grid.index(p) + 1) * (folds + 1) - 1
        return network_model(wanted[last], data, weights[last])

    return scores, refit


# Families whose grid points and folds share work: each gives the scores of a grid and, if it has them, the models on all rows.
JOINT = {"knn": _knn_scores, "naive_bayes": _bayes_scores, "decision_tree": _tree_scores, "random_forest": _forest_scores, "boosted_trees": _boosted_scores, "svc": _svc_scores, "mlp": _mlp_scores}


@dataclass(frozen=True)
class Score:
    model: str
    best_score: float
    best_params: dict
    best_estimator: object


def search(data: DataFrame, grids: dict[str, list[dict]], shape: Shape, folds: int, parallelism: int = 4) -> list[Score]:
    """Best parameters of every family, refitted on all of ``data``.

    Families in ``JOINT`` answer their whole grid over all folds together.  The
    grid points of the others are fitted side by side from driver threads, as
    they are independent jobs on the same materialized frame.
    """
    alone = [(name, params) for name, grid in grids.items() for params in grid if name not in JOINT]

    def score(point):
        name, params = point
        return cross_validate(data, lambda s: ESTIMATORS[name](params, s), shape, folds)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scores = dict(zip(range(len(alone)), pool.map(score, alone)))
    result = []
    for name, grid in grids.items():
        if name in JOINT:
            found, refit = JOINT[name](data, grid, shape, folds, parallelism)
        else:
            found, refit = [scores[i] for i, (other, _) in enumerate(alone) if other == name], None
        # max() keeps the first of equal scores.
        best, params = max(zip(found, grid), key=lambda s: s[0])
        fitted = refit(params) if refit else ESTIMATORS[name](params, shape).fit(data.select("features", "label"))
        result.append(Score(name, best, params, fitted))
    return result
