"""The dictionary of categories as a table, of any size."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patronage.operators import categories, ltv
from patronage.operators.categories import CategoryIndexer, CategoryIndexerModel, numbered_values


@pytest.mark.parametrize("ranges, size", [(1000, 10_000), (13, 7), (1000, 2)])
def test_numbers_follow_the_order(spark, ranges, size):
    words = sorted({f"{'prefix' if i % 3 else 'é'}{i * 7919 % 1000}" for i in range(400)}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in words + words[:50] + [None]], "a string").repartition(5)
    got = {r.value: r["index"] for r in numbered_values(df, "a", ranges, size).collect()}
    assert got == {w: float(i) for i, w in enumerate(words)}


def test_unseen_null_and_empty(spark, tmp_path):
    train = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y")], "s string, t string")
    model = CategoryIndexer(inputCols=["s", "t"], outputCols=["i", "j"]).fit(train)
    test = spark.createDataFrame([("a", "y"), ("new", None), (None, "x")], "s string, t string")
    want = [("a", "y", 0.0, 1.0), ("new", None, 2.0, 2.0), (None, "x", 2.0, 0.0)]
    assert sorted(map(tuple, model.transform(test).collect()), key=repr) == sorted(want, key=repr)
    for saved, kind in ((model, CategoryIndexerModel), (PipelineModel([model]), PipelineModel)):
        saved.write().overwrite().save(str(tmp_path / kind.__name__))
        again = kind.load(str(tmp_path / kind.__name__)).transform(test).collect()
        assert sorted(map(tuple, again), key=repr) == sorted(want, key=repr)
    none = CategoryIndexer(inputCols=["s"], outputCols=["i"]).fit(train.limit(0))
    assert none.sizes == [0] and {r.i for r in none.transform(test).collect()} == {0.0}


def test_a_hundred_thousand_categories(spark, monkeypatch):
    """No refusal, no labels on the driver, sparse features; the join is used beyond the broadcast's bound."""
    monkeypatch.setattr(categories, "BROADCAST_VALUES", 1000)
    train = spark.range(150_000).select(F.concat(F.lit("c"), (F.col("id") % 100_000).cast("string")).alias("name"), (F.col("id") % 7).cast("double").alias("x"))
    model = ltv.preprocessor(train, ["x"], ["name"])
    out = model.transform(train)
    row = out.where("name = 'c5'").select("features").first()[0]
    assert row.size == 100_001 and row.numNonzeros() == 2 and row[0] == pytest.approx(5 / 6)
    hot = out.select(F.col("features").cast("string").alias("f")).distinct().count()
    assert hot == out.select("name", "x").distinct().count()
    plan = out.select("features")._jdf.queryExecution().optimizedPlan().toString()
    assert "c99999" not in plan


def test_same_features_as_before(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 3.0), ("a", 2.0)], "s string, x double")
    out = ltv.preprocessor(train, ["x"], ["s"]).transform(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("zz", 2.0), (None, None)], "s string, x double"))
    got = [r[0] for r in out.select(vector_to_array("features")).collect()]
    assert sorted(got) == sorted([[0.0, 1.0, 0.0], [1.0, 0.0, 1.0], [0.5, 0.0, 0.0], [0.5, 1.0, 0.0]])
