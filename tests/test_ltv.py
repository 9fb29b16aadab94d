import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from patronage import FullAnalysis, LifetimeValuePredictor, RFMSegmentation
from patronage.operators import ltv
from patronage.operators.models import DEFAULT_GRIDS, ESTIMATORS, MODERN, Shape, search
from patronage.operators.nearest import NearestNeighbors
from patronage.operators.rfm import REVENUE
from patronage.plans.catalog import SEARCH_GRIDS

from conftest import records


def purchases(n=45):
    rows = []
    for i in range(n):
        for j in range(1 + i % 5):
            rows.append((f"c{i:02d}", ["x", "y", "z"][i % 3], 10.0 + 40 * (i % 3) + i / 10, f"2020-{1 + (i + j) % 9:02d}-{1 + i % 28:02d}"))
    return rows


@pytest.fixture(scope="module")
def segmentation(spark):
    from patronage import Dates, Entity, Sale, bind
    from conftest import frame

    base = bind(frame(spark, purchases()), Entity("customer", segment="segment"), Sale("sale"), Dates("date"))
    return RFMSegmentation(base)


def revenue_frame(spark, values):
    return spark.createDataFrame([(f"c{i}", float(v)) for i, v in enumerate(values)], f"customer string, `{REVENUE}` double")


def test_feature_frame_has_a_row_per_segment(make_base):
    base = make_base([("a", "x", 1.0, "2020-01-01"), ("a", "y", 2.0, "2020-01-01"), ("b", None, 4.0, "2020-01-01"), (None, "x", 8.0, "2020-01-01")])
    from patronage.operators import rfm

    frame = ltv.feature_frame(rfm.rfm(base.measures, with_revenue=True), base.measures)
    assert records(frame, "customer", "customer_segment", REVENUE) == [("a", "x", 3.0), ("a", "y", 3.0), ("b", None, 4.0)]


def test_trim_is_strict(spark):
    df = revenue_frame(spark, [1, 2, 3, 10, 10])
    assert records(ltv.trim_outliers(df, 1), REVENUE) == [(1.0,), (2.0,), (3.0,)]
    assert records(ltv.trim_outliers(df, 0.3), REVENUE) == [(1.0,), (2.0,)]


def test_cluster_hint(spark):
    df = revenue_frame(spark, [1, 2, 11, 12, 21, 22, 31, 32, 41, 42])
    hint = [tuple(r) for r in ltv.cluster_hint(df).collect()]
    assert [k for k, _ in hint] == list(range(1, 10))
    sse = [v for _, v in hint]
    assert sse[0] == pytest.approx(2002.5) and sse[4] == pytest.approx(2.5)
    assert sse == sorted(sse, reverse=True)


def test_clusters_and_their_info(spark):
    df = ltv.with_ltv_cluster(revenue_frame(spark, [100, 1, 2, 50, 51]), 3)
    assert records(ltv.ltv_cluster_info(df)) == [(0, 1.5, 2), (1, 50.5, 2), (2, 100.0, 1)]
    assert ltv.ltv_cluster_info(df).columns == ["LTV Cluster", "Life Time Value (Revenue)", "Customer Count"]


def test_features_by_type(segmentation):
    frame = LifetimeValuePredictor(segmentation).frame
    numeric, categorical = ltv.feature_columns(frame)
    assert numeric == ["Recency", "Frequency", "Monetary", "Recency cluster", "Frequency cluster", "Monetary cluster", "RFM Overall Score"]
    assert categorical == ["RFM Segment", "customer_segment"]
    assert ltv.feature_columns(frame, include_customer_id=True)[1][0] == "customer"


def test_preprocessor(spark):
    train = spark.createDataFrame([(0, 1.0, "a"), (10, None, "b"), (5, 3.0, None), (None, 3.0, "b")], "n long, v double, s string")
    model = ltv.preprocessor(train, ["n", "v"], ["s"])
    score = spark.createDataFrame([(10, 2.0, "a"), (None, None, None), (0, 1.0, "it's new")], "n long, v double, s string")
    got = [[round(x, 4) for x in r[0]] for r in model.transform(score).select(vector_to_array("features")).collect()]
    # Means 5 and 7/3; the commonest text is b; unseen text encodes as zeros.
    assert got == [[1.0, 0.5, 1.0, 0.0], [0.5, 0.6667, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0]]


def test_most_frequent_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,)], "s string")
    assert ltv.most_frequent(df, "s") == "a"
    assert ltv.most_frequent(df.filter("s is null"), "s") is None


def test_text_with_quotes_as_fill(spark):
    train = spark.createDataFrame([("it's \\ odd",), ("it's \\ odd",), (None,)], "s string")
    got = ltv.preprocessor(train, [], ["s"]).transform(train).select(vector_to_array("features")).collect()
    assert [r[0] for r in got] == [[1.0]] * 3


def test_folds_are_even_within_labels(spark):
    df = spark.range(103).select(
        F.col("id").cast("string").alias("customer"), F.lit("x").alias("customer_segment"), (F.col("id") % 10 == 0).cast("int").alias("LTV Cluster")
    )
    answers = set()
    for parts in (1, 7):
        folded = ltv.with_folds(df.repartition(parts), 5)
        answers.add(tuple(records(folded, "customer", "fold")))
        assert folded.count() == 103 and set(folded.columns) == {*df.columns, "fold"}
        sizes = {}
        for label, fold, n in folded.groupBy("LTV Cluster", "fold").count().collect():
            sizes.setdefault(label, []).append(n)
        for counts in sizes.values():
            assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert len(answers) == 1


def test_nearest_neighbours_break_ties_by_label(spark):
    train = spark.createDataFrame([(Vectors.dense([1.0]), float(i % 2)) for i in range(400)], ["features", "label"])
    for parts in (1, 6):
        model = NearestNeighbors(k=50).fit(train.repartition(parts))
        assert model.transform(train.limit(3)).select("prediction").distinct().collect()[0][0] == 0.0


@pytest.mark.parametrize("k", [1, 5, 200])
def test_nearest_neighbours_against_brute_force(spark, k):
    rng = np.random.default_rng(4)
    points, labels = rng.normal(size=(60, 3)), rng.integers(0, 3, size=60)
    queries = rng.normal(size=(25, 3))
    train = spark.createDataFrame([(Vectors.dense(p), float(c)) for p, c in zip(points, labels)], ["features", "label"])
    test = spark.createDataFrame([(i, Vectors.dense(q)) for i, q in enumerate(queries)], ["i", "features"])
    model = NearestNeighbors(k=k).fit(train)
    got = dict(records(model.transform(test), "i", "prediction"))
    for i, q in enumerate(queries):
        near = labels[np.argsort(((points - q) ** 2).sum(axis=1))[:k]]
        assert got[i] == np.bincount(near).argmax()


def test_default_grids():
    assert {name: len(grid) for name, grid in DEFAULT_GRIDS.items()} == {
        "logistic_regression": 3, "knn": 3, "naive_bayes": 1, "svc": 9, "decision_tree": 6, "random_forest": 6, "boosted_trees": 8, "mlp": 2,
    }
    assert set(ESTIMATORS) == set(DEFAULT_GRIDS) and MODERN == ("random_forest", "boosted_trees", "mlp")
    shape = Shape(100, 4, 3)
    for name, grid in DEFAULT_GRIDS.items():
        for params in grid:
            assert ESTIMATORS[name](params, shape) is not None


FAST_GRIDS = {
    "logistic_regression": [{"C": 10, "max_iter": 10}],
    "knn": [{"n_neighbors": 3}],
    "naive_bayes": [{}],
    "svc": [{"C": 1, "max_iter": 5}],
    "decision_tree": [{"criterion": "gini", "max_depth": 1}, {"criterion": "entropy", "max_depth": 5}],
    "random_forest": [{"n_estimators": 3, "criterion": "gini", "max_depth": 4}],
    "boosted_trees": [{"learning_rate": 0.1, "n_estimators": 2, "max_depth": 2}],
    "mlp": [{"hidden_layer_sizes": (4,), "max_iter": 10}],
}


def test_registered_searches_shrink_no_model():
    whole = ("logistic_regression", "knn", "naive_bayes", "decision_tree")
    assert {f: SEARCH_GRIDS[f] for f in whole} == {f: DEFAULT_GRIDS[f] for f in whole}
    assert set(SEARCH_GRIDS) == set(DEFAULT_GRIDS)
    assert all(grid and all(point in DEFAULT_GRIDS[f] for point in grid) for f, grid in SEARCH_GRIDS.items())


def test_search_and_prediction(segmentation, make_base):
    predictor = LifetimeValuePredictor(segmentation)
    with pytest.raises(RuntimeError):
        predictor.run_best_predictor(segmentation)
    scores = predictor.choose_best_predictor(cv=2, grids=FAST_GRIDS)
    assert [s.model for s in scores] == list(FAST_GRIDS)
    assert all(0 <= s.best_score <= 1 for s in scores)
    info = predictor.ltv_cluster_info.collect()
    # The highest revenue is trimmed by default.
    assert sum(r["Customer Count"] for r in info) == 44
    majority = max(r["Customer Count"] for r in info) / 44
    assert predictor.best.best_score > majority
    assert predictor.best.best_score == max(s.best_score for s in scores)
    assert predictor.best_estimator is predictor.best.best_estimator
    table = predictor.predictor_scores
    assert table.columns == ["model", "best_score", "best_params"] and table.count() == len(FAST_GRIDS)

    predicted = predictor.run_best_predictor(segmentation)
    assert predicted.columns == ["customer", "Life Time Value Predicted"]
    assert predicted.count() == 45
    assert {r[1] for r in predicted.collect()} <= {0, 1, 2}
    # Segments absent from training, and missing ones, can be scored.
    other = [(c, None if i % 2 else "unseen", v, d) for i, (c, _, v, d) in enumerate(purchases())]
    scored = predictor.run_best_predictor(RFMSegmentation(make_base(other)))
    assert scored.filter(F.col("Life Time Value Predicted").isNull()).count() == 0


def test_repeated_calls_start_from_all_customers(segmentation):
    predictor = LifetimeValuePredictor(segmentation)
    for _ in range(2):
        predictor.choose_best_predictor(revenue_clusters=2, cv=2, grids={"naive_bayes": [{}]})
        assert predictor.ltv_cluster_info.agg(F.sum("Customer Count")).first()[0] == 44
        assert predictor.ltv_cluster_info.count() == 2


def test_missing_features_warn(make_base):
    rows = [(c, None if c == "c01" else s, v, d) for c, s, v, d in purchases(20)]
    predictor = LifetimeValuePredictor(RFMSegmentation(make_base(rows)))
    with pytest.warns(UserWarning, match="missing"):
        predictor.choose_best_predictor(cv=2, grids={"naive_bayes": [{}]})


def test_ties_keep_the_first(spark):
    rows = [(Vectors.dense([float(i % 2)]), float(i % 2), i // 2 % 2) for i in range(20)]
    data = spark.createDataFrame(rows, ["features", "label", "fold"])
    grids = {"decision_tree": [{"criterion": "gini", "max_depth": 2}, {"criterion": "entropy", "max_depth": 2}]}
    best = search(data, grids, Shape(20, 1, 2), folds=2)[0]
    assert best.best_score == 1.0 and best.best_params["criterion"] == "gini"


def test_full_analysis(make_base):
    with FullAnalysis(make_base(purchases())) as suite:
        assert list(suite.full_result()) == ["Basic Info", "Growth", "New Existing Customer", "Retention", "Cohort", "Segmentation"]
        data = suite.analysis_data()
        assert set(data["Cohort data"]) == {"by_revenue", "by_revenue_pct", "by_retention", "by_retention_pct"}
        assert data["Basic Info data"]["customer_revenue"].count() == 45
        assert data["Segmentation data"]["segment"].count() == 45
        charts = suite.chart_data()
        assert set(charts["Retention chart"]) == {"retention", "retention_pct"}
        assert charts["Growth chart"]["monthly_revenue"].count() == 9
        assert suite.predictor.frame.count() == 45
        assert suite.base._cached is not None
    assert suite.base._cached is None
