"""Text categories as indexes from a dictionary table of any size.

The different values of a column are numbered in their order without bringing
them together: a bounded sample of them parts the order into ranges, the values
of each range are counted, and a value's index is the number of values in the
ranges before its own plus its place there.  The dictionary stays a table; rows
get their index by a join, which is broadcast only while the dictionary is
small.  The driver knows the number of categories of each column, no labels.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Window, functions as F

from .materialize import cut, materialize, release

# Different values that part the order into ranges, and values of a range from which on there is a further one.
RANGES, RANGE_VALUES = 1000, 10_000
# Values of a column up to which its dictionary is broadcast.
BROADCAST_VALUES = 100_000


def numbered_values(frame: DataFrame, column: str, ranges: int = RANGES, range_values: int = RANGE_VALUES) -> DataFrame:
    """(value, index) of the different values other than null, numbered from 0 in their order."""
    values = cut(frame.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct())
    kinds = values.count()
    wanted = min(ranges, kinds // range_values)
    if wanted:
        # A random but repeatable sample of the values; those up to a bound belong to its range.
        chosen = values.orderBy(F.xxhash64("value"), "value").limit(wanted)
        bounds = chosen.agg(F.array_sort(F.collect_list("value")).alias("bounds"))
        # One row with an array of at most RANGES values, beside every value (a higher-order function cannot hold a subquery).
        placed = values.join(F.broadcast(bounds)).select("value", _upto(F.col("bounds"), F.col("value")).alias("range"))
    else:
        placed = values.select("value", F.lit(0).alias("range"))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    # One row per range.
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("value"))
    return placed.withColumn("place", place).join(F.broadcast(offsets), "range").select("value", (F.col("offset") + F.col("place") - 1).cast("double").alias("index"))


def _upto(bounds: Column, value: Column) -> Column:
    """How many of the sorted bounds are at most the value, by halving."""
    low, high = F.lit(0), F.size(bounds)
    start = F.struct(low.alias("low"), high.alias("high"))

    def halve(at, _):
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_, above = at["low"] < at["high"], F.get(bounds, middle) > value
        return F.struct(
            F.when(open_ & ~above, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(open_ & above, middle).otherwise(at["high"]).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(RANGES.bit_length())), start, halve, lambda at: at["low"])


class CategoryIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsWritable, DefaultParamsReadable):
    """Indexes of text columns in the order of their values; a value that was not seen gets the number of categories."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "CategoryIndexerModel":
        tables = [numbered_values(dataset, c).withColumn("column", F.lit(i)) for i, c in enumerate(self.getInputCols())]
        whole = tables[0]
        for more in tables[1:]:
            whole = whole.unionByName(more)
        dictionary = materialize(whole.select("column", "value", "index"))
        sizes = {r.column: r.n for r in dictionary.groupBy("column").agg(F.count("*").alias("n")).collect()}
        return self._copyValues(CategoryIndexerModel(dictionary, [sizes.get(i, 0) for i in range(len(tables))]))


class CategoryIndexerModel(Model, HasInputCols, HasOutputCols, MLWritable, MLReadable):
    """``dictionary`` has (column, value, index), ``sizes`` the number of categories of each column."""

    def __init__(self, dictionary: DataFrame | None = None, sizes: list[int] | None = None):
        super().__init__()
        self.dictionary, self.sizes = dictionary, sizes or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for i, (name, out, size) in enumerate(zip(self.getInputCols(), self.getOutputCols(), self.sizes)):
            own = self.dictionary.where(F.col("column") == i).select(F.col("value").alias("__value"), F.col("index").alias("__index"))
            own = F.broadcast(own) if size <= BROADCAST_VALUES else own
            joined = dataset.join(own, dataset[f"`{name}`"] == F.col("__value"), "left")
            dataset = joined.withColumn(out, F.coalesce("__index", F.lit(float(size)))).drop("__value", "__index")
        return dataset

    def close(self) -> None:
        """Free the dictionary if it is persisted; the model cannot be used afterwards."""
        release(self.dictionary)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CategoryIndexerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"sizes": json.dumps(self.model.sizes)})
        self.model.dictionary.write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def load(self, path: str) -> CategoryIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CategoryIndexerModel(self.sparkSession.read.parquet(f"{path}/dictionary"), json.loads(metadata["sizes"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
