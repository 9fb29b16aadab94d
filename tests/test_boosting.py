"""Boosted trees against a plain version, their prefixes, partitioning and storage."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from patronage.operators import boosting as B


def sample(n=150, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    rows = np.column_stack([rng.normal(size=n), rng.integers(0, 4, size=n), np.round(rng.normal(size=n), 1)])
    labels = ((rows[:, 0] > 0.3).astype(int) + (rows[:, 1] > 1) * (rows[:, 2] > 0) + (rng.random(n) < 0.1)) % classes
    return rows, labels, rng.integers(0, 3, size=n)


def frame(spark, rows, labels, folds):
    data = [(i, Vectors.dense(r), float(c), int(f)) for i, (r, c, f) in enumerate(zip(rows, labels, folds))]
    return spark.createDataFrame(data, ["i", "features", "label", "fold"])


def as_vectors(df):
    return df.select(B.vector_to_array("features").alias("vector"), F.col("label").cast("int").alias("label"), "fold")


def plain(rows, labels, mine, rate, depth, rounds, classes=3):
    """Margins of all rows after each round of a straightforward version."""
    margins, out = np.zeros((classes, len(rows))), []
    for _ in range(rounds):
        odds = np.exp(margins - margins.max(axis=0))
        p = odds / odds.sum(axis=0)
        g = np.rint((p - (np.arange(classes)[:, None] == labels)) * B.UNIT) / B.UNIT
        h = np.rint(np.maximum(2 * p * (1 - p), 1e-16) * B.UNIT) / B.UNIT
        added = np.zeros_like(margins)
        for c in range(classes):

            def grow(inside, left):
                own = inside & mine
                G, H = g[c][own].sum(), h[c][own].sum()
                best = None
                for j in range(rows.shape[1]) if left else ():
                    values = np.unique(rows[mine | ~mine, j])
                    for t in (values[1:] + values[:-1]) / 2:
                        side = own & (rows[:, j] <= t)
                        lg, lh = g[c][side].sum(), h[c][side].sum()
                        if lh < B.LEAST_HESSIAN or H - lh < B.LEAST_HESSIAN:
                            continue
                        gain = round(lg**2 / (lh + 1) + (G - lg) ** 2 / (H - lh + 1) - G**2 / (H + 1), 9)
                        if gain > B.LEAST_GAIN and (best is None or (-gain, j) < best[:2]):
                            best = (-gain, j, t)
                if best is None:
                    added[c][inside] = rate * -G / (H + 1)
                else:
                    right = rows[:, best[1]] > best[2]
                    grow(inside & ~right, left - 1)
                    grow(inside & right, left - 1)

            grow(np.ones(len(rows), bool), depth)
        margins = margins + added
        out.append(margins)
    return out


def test_equal_to_a_plain_version(spark):
    rows, labels, folds = sample()
    data = as_vectors(frame(spark, rows, labels, folds)).cache()
    for parts, block in ((1, 4096), (5, 7)):
        wanted = [B.Ensemble(0.3, 3, 0), B.Ensemble(0.1, 2, -1)]
        edges, shares = B.train(data.repartition(parts), wanted, 4, 3, 3, judged=(2, 4), block_rows=block)
        for e, (rate, depth, fold) in enumerate(((0.3, 3, 0), (0.1, 2, -1))):
            want = plain(rows, labels, folds != fold, rate, depth, 4)
            bins = np.column_stack([np.searchsorted(edges[j], rows[:, j], "left") for j in range(3)])
            margins = np.zeros((1, 3, len(rows)))
            B._advance(margins, bins, [(rate, [[t.arrays() for t in by_class] for by_class in wanted[e].rounds])])
            assert np.allclose(margins[0], want[-1], atol=1e-6)
            if fold >= 0:
                held = folds == fold
                for number in (2, 4):
                    assert shares[e, number] == pytest.approx(np.mean(want[number - 1].argmax(axis=0)[held] == labels[held]))
    data.unpersist()


def test_stored_margins_and_prefixes(spark, monkeypatch):
    rows, labels, folds = sample(120, 2)
    data = as_vectors(frame(spark, rows, labels, folds)).cache()
    long = [B.Ensemble(0.3, 2, 1)]
    _, shares = B.train(data, long, 7, 3, 3, judged=(3, 7))
    monkeypatch.setattr(B, "KEPT_ROUNDS", 2)
    again = [B.Ensemble(0.3, 2, 1)]
    assert B.train(data, again, 7, 3, 3, judged=(3, 7))[1] == shares
    assert again[0].rounds == long[0].rounds
    short = [B.Ensemble(0.3, 2, 1)]
    B.train(data, short, 3, 3, 3)
    assert short[0].rounds == long[0].rounds[:3]
    data.unpersist()


def test_model_learns_is_saved_and_counts_rounds(spark, tmp_path):
    rows, labels, folds = sample(300, 4)
    df = frame(spark, rows, labels, folds)
    model = B.BoostedTreesClassifier(rate=0.3, rounds=6, maxDepth=3, predictionCol="guess").fit(df)
    got = model.transform(df)
    want = {r.i: r.guess for r in got.collect()}
    right = got.where("guess = label").count() / 300
    assert right > 0.85 > np.bincount(labels).max() / 300
    for saved, kind in ((model, B.BoostedTreesModel), (PipelineModel([model]), PipelineModel)):
        path = str(tmp_path / kind.__name__)
        saved.write().overwrite().save(path)
        assert {r.i: r.guess for r in kind.load(path).transform(df).collect()} == want
    assert len(model.trees) == 6
    model._set(rounds=0)
    assert {r.guess for r in model.transform(df).collect()} == {0.0}


def test_many_values_one_class_and_no_rows(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(600, 1))
    labels = (rows[:, 0] > 0.5).astype(int)
    df = frame(spark, rows, labels, np.zeros(600))
    edges = B.bin_edges(as_vectors(df), 1, 32)
    assert 20 <= len(edges[0]) <= 31
    assert B.BoostedTreesClassifier(rounds=3, maxDepth=1, rate=0.5).fit(df).transform(df).where("prediction <> label").count() < 20
    single = df.withColumn("label", F.lit(0.0))
    assert {r.prediction for r in B.BoostedTreesClassifier(rounds=2).fit(single).transform(single).collect()} == {0.0}
    assert B.BoostedTreesClassifier(rounds=2).fit(df.limit(0)).transform(df.limit(0)).collect() == []


def test_a_node_is_one_row_of_a_task_however_many_bins(spark):
    """Histograms are sent as arrays, not as a row of each bin, and rows are dealt out to several tasks."""
    rows, labels, folds = sample(3000)
    data = as_vectors(frame(spark, rows, labels, folds)).coalesce(1).cache()
    edges = B.bin_edges(data, 3)
    kinds = [len(e) + 1 for e in edges]
    state = B.blocks(B.spread(data), edges, 3)
    assert state.rdd.getNumPartitions() == 3
    tree = [[B.Boosted().arrays() for _ in range(3)]]
    shared = spark.sparkContext.broadcast(([], tree, [[np.array([0])] * 3], [-1]))
    sent = B._histograms(state, shared, 3, kinds)
    assert sent.count() == 3 * 3
    found = B._splits(sent, kinds, 2).collect()
    assert sorted((r.slot, r.node) for r in found) == [(0, 0), (1, 0), (2, 0)] and all(r.ah > 0 for r in found)
    data.unpersist()


def test_features_of_few_bins_share_columns_and_blocks_hold_one_fold(spark):
    """A row costs a column of several features one histogram, and an ensemble skips the blocks of the fold that it leaves out."""
    rng = np.random.default_rng(7)
    n, kinds = 700, [1, 40, 2, 2, 3, 70, 4]
    bins = np.column_stack([rng.integers(0, k, size=n) for k in kinds])
    columns = B.columns_of(kinds)
    assert sorted(j for column in columns for j, _ in column) == list(range(7)) and len(columns) == 3
    cells = np.array([sum(bins[:, j] * stride for j, stride in column) for column in columns])
    assert all(own.max() < size <= max(B.SHARED_CELLS, 70) for own, size in zip(cells, B._sizes(columns, kinds)))
    tree = B.Boosted()
    for node, j, at in ((0, 1, 20), (1, 4, 1), (2, 5, 33), (4, 2, 0), (5, 6, 2)):
        tree.split(node, j, at, (0.5, -0.25))
    assert np.array_equal(B._ends(cells, B._paths(tree.arrays(), columns, kinds)), B._leaves(bins, *tree.arrays()))
    labels, folds = rng.integers(0, 3, size=n), rng.integers(0, 4, size=n)
    data = as_vectors(frame(spark, bins.astype(float), labels, folds)).repartition(2)
    edges = [np.arange(k - 1) + 0.5 for k in kinds]
    held = B.blocks(data, edges, 3, 50).collect()
    assert {r.fold for r in held} == {0, 1, 2, 3} and sum(r.n for r in held) == n and max(r.n for r in held) == 50
    for r in held:
        assert len(r.bins) == 2 * 3 * r.n and len(r.label) == 4 * r.n and len(r.margins) == 4 * 3 * r.n
    back = np.concatenate([np.frombuffer(r.bins, "<u2").reshape(3, -1) for r in held], axis=1)
    whole = np.column_stack([back.T, np.concatenate([np.frombuffer(r.label, "<i4") for r in held]), np.repeat([r.fold for r in held], [r.n for r in held])])
    want = np.column_stack([cells.T, labels, folds])
    assert sorted(map(tuple, whole.tolist())) == sorted(map(tuple, want.tolist()))


def test_of_two_children_one_is_counted(spark, monkeypatch):
    """The other's histogram is what its sibling's lacks of their parent's; trees are the same as if both were counted."""
    rows, labels, folds = sample(400, 9)
    data = as_vectors(frame(spark, rows, labels, folds)).cache()
    seen = []
    real = B._histograms
    monkeypatch.setattr(B, "_histograms", lambda state, shared, *rest: (seen.append([len(n) for by_class in shared.value[2] for n in by_class]), real(state, shared, *rest))[1])
    one = [B.Ensemble(0.3, 3, 0), B.Ensemble(0.3, 2, -1)]
    B.train(data, one, 2, 3, 3)
    halved = [sum(x) for x in seen]
    assert halved[0] == 6 and 0 < halved[1] <= 6 and 0 < halved[2] <= 6
    seen.clear()
    monkeypatch.setattr(B, "KEPT_BYTES", 0)
    two = [B.Ensemble(0.3, 3, 0), B.Ensemble(0.3, 2, -1)]
    B.train(data, two, 2, 3, 3)
    assert [e.rounds for e in two] == [e.rounds for e in one] and sum(map(sum, seen)) > sum(halved)
    data.unpersist()
