"""Joint descent of support-vector machines and perceptrons against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors

from patronage.operators import descent, margins, perceptron
from patronage.operators.models import JOINT, Shape


def frame(spark, rows, labels, folds):
    data = [(Vectors.dense(r), float(c), int(f)) for r, c, f in zip(rows, labels, folds)]
    return spark.createDataFrame(data, ["features", "label", "fold"]).coalesce(1)


def sample(n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = np.column_stack([rng.normal(size=n), 5 + 2 * rng.normal(size=n), np.ones(n)])
    labels = (rows[:, 0] > 0.4).astype(int) + (rows[:, 0] + 0.3 * rng.normal(size=n) < -0.4) * 2
    return rows, labels, np.arange(n) % 3


def test_descent_finds_the_minimum_of_many_problems_in_few_jobs():
    matrices = [np.diag([1.0, 30.0, 900.0]), np.diag([2.0, 2.0, 2.0])]
    jobs = []

    def answer(asked):
        jobs.append(len(asked))
        return {i: (0.5 * (w - i) @ matrices[i] @ (w - i), matrices[i] @ (w - i)) for i, w in asked.items()}

    found = descent.solve([descent.minimize(np.full(3, 4.0), 100, 1e-9) for _ in matrices], answer)
    for i, w in enumerate(found):
        assert np.allclose(w, i, atol=1e-3)
    assert jobs[0] == 2 and len(jobs) < 100


def test_hinge_loss_is_as_low_as_of_linear_svc(spark):
    rows, labels, folds = sample()
    data = frame(spark, rows, labels, folds).cache()
    penalty, kept = 1 / 150, folds != 1

    def loss(coefficients, intercept, c):
        sign = np.where(labels[kept] == c, 1, -1)
        return np.maximum(0, 1 - sign * (rows[kept] @ coefficients + intercept)).mean() + penalty / 2 * coefficients @ coefficients

    trained = []
    real = margins.summed
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(margins, "summed", lambda b, f, shared, n: (trained.append(shared.value) if f is margins.hits else None, real(b, f, shared, n))[1])
        share = margins.accuracies(data, [margins.Machine(penalty, 1)], 3)[0]
    (_, coefficients, intercepts), = trained[0]
    for c in (0, 2):
        model = LinearSVC(regParam=penalty, standardization=False, maxIter=30).fit(data.where("fold <> 1").selectExpr("features", f"double(label = {c}) AS label"))
        assert loss(coefficients[c], intercepts[c], c) <= loss(model.coefficients.toArray(), model.intercept, c) + 2e-3
    guess = (rows[~kept] @ coefficients.T + intercepts).argmax(axis=1)
    assert share == pytest.approx(np.mean(guess == labels[~kept])) and share > 0.6
    data.unpersist()


def test_network_is_that_of_spark(spark):
    rows, labels, folds = sample(seed=1)
    data = frame(spark, rows, labels, folds).cache()
    own = perceptron.Network((3, 4, 5, 3), 0, 60)
    weights, shares = perceptron.train(data, [own, perceptron.Network((3, 4, 5, 3), -1, 60)])
    assert shares[0] > 0.75 and shares[1] == 0.0
    model = perceptron.model_of(own, data, weights[1])
    assert np.allclose(model.weights.toArray(), weights[1]) and model.getMaxIter() == 60
    want = perceptron._forward(rows, perceptron._affine(own.layers, weights[1]))[-1]
    got = np.array([r.probability.toArray() for r in model.transform(data).collect()])
    assert np.allclose(got, want, atol=1e-9)
    at, step = weights[0], 1e-6
    asked = lambda w: perceptron.entropy(rows, labels, folds, [(own.layers, 0, w)])
    slope = asked(at)[1:]
    for i in (0, 7, 20, len(at) - 1):
        moved = at.copy()
        moved[i] += step
        assert (asked(moved)[0] - asked(at)[0]) / step == pytest.approx(slope[i], abs=1e-2)
    data.unpersist()


@pytest.mark.parametrize("family, grid", [("svc", [{"C": 1, "kernel": "linear"}, {"C": 10, "kernel": "linear"}]), ("mlp", [{"hidden_layer_sizes": (4, 4), "max_iter": 20}])])
def test_a_grid_over_all_folds_is_one_descent(spark, family, grid):
    """Jobs do not multiply with points, classes and folds."""
    rows, labels, folds = sample(120)
    data = frame(spark, rows, labels, folds).cache()
    seen = []
    real = descent.solve
    with pytest.MonkeyPatch.context() as patch:
        for module in (margins, perceptron):
            patch.setattr(module, "solve", lambda problems, answer: seen.append(len(problems)) or real(problems, answer))
        scores, _ = JOINT[family](data, grid, Shape(120, 3, 3), 3, 2)
    assert len(scores) == len(grid) and min(scores) > 0.4
    assert seen == [2 * 3 * 3 if family == "svc" else 3 + 1]
    data.unpersist()


def test_networks_descend_in_single_precision_and_end_in_doubles(spark, monkeypatch):
    """Steps are computed in single precision; only doubles end a descent before its last step."""
    rows, labels, folds = sample(400, 3)
    labels = np.minimum(labels, 2)
    labels[::7] = 0  # the loss has a minimum well above zero
    data = frame(spark, rows, labels, folds).cache()
    seen = []
    real = perceptron.summed
    monkeypatch.setattr(perceptron, "summed", lambda b, f, shared, n: (seen.append([w.dtype for *_, w in shared.value]) if f is perceptron.entropy else None, real(b, f, shared, n))[1])
    few = perceptron.train(data, [perceptron.Network((3, 2, 3), 0, 3)])[0]
    assert {k for kinds in seen for k in kinds} == {np.dtype("f4")} and few[0].dtype == np.float64
    seen.clear()
    (weights,), _ = perceptron.train(data, [perceptron.Network((3, 2, 3), 0, 400)])
    assert seen[0] == [np.dtype("f4")] and seen[-1] == [np.dtype("f8")]
    loss, *slope = perceptron.entropy(rows, labels, folds, [((3, 2, 3), 0, weights)])
    assert np.linalg.norm(slope) < 1e-3 * loss
    data.unpersist()


def test_a_network_in_single_precision_has_the_slope_of_doubles():
    """Folds are slices, chunks are added up, large odds do not overflow."""
    rows, labels, folds = sample(3000, 4)
    labels = np.minimum(labels, 2)
    weights = np.random.default_rng(5).normal(size=4 * 6 + 7 * 5 + 6 * 3)
    layers, other = (3, 6, 5, 3), (3, 4, 3)
    asked = [(layers, 1, weights), (other, -1, weights[: 4 * 4 + 5 * 3]), (layers, 2, 300 * weights)]
    want = perceptron.entropy(rows, labels, folds, asked)
    got = perceptron.entropy(rows, labels, folds, [(own, out, w.astype("f4")) for own, out, w in asked])
    assert got.dtype == np.float64 and np.isfinite(got).all() and not np.array_equal(got, want)
    place = 0
    for own, out, w in asked[:2]:
        mine, size = folds != out, len(w) + 1
        alone = sum(perceptron.entropy(rows[i : i + 1], labels[i : i + 1], folds[i : i + 1], [(own, -1, w)]) for i in np.flatnonzero(mine))
        assert np.allclose(want[place : place + size], alone, rtol=1e-9, atol=1e-9)
        assert np.abs(got[place : place + size] - alone).max() < 1e-5 * np.abs(alone).max()
        place += size
    assert got[place] == pytest.approx(want[place], rel=1e-3)
