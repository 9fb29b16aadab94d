"""Lifetime-value clusters of customers and the features that predict them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer,
    MinMaxScaler,
    OneHotEncoder,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.nulls import known
from . import kmeans1d
from .categories import CategoryIndexer
from .quantile import exact_quantile
from .rfm import REVENUE

LABEL = "LTV Cluster"
PREDICTED = "Life Time Value Predicted"
# Hexadecimal digits of the customers' digests that make the buckets of the folds.
FOLD_DIGITS = 3


def customer_segments(measures: DataFrame) -> DataFrame:
    """Distinct pairs of customer and segment."""
    return measures.filter(known("customer")).select("customer", "customer_segment").distinct()


def feature_frame(segment: DataFrame, measures: DataFrame) -> DataFrame:
    """Segmented customers with their own segment; one row per pair, so a
    customer of several segments has several rows."""
    return segment.join(customer_segments(measures), "customer", "left")


def cluster_hint(frame: DataFrame, most: int = 9) -> DataFrame:
    """Inertia of the revenue clusters for 1, 2, ... ``most`` clusters.

    All cluster counts are fitted in the same passes over the data.
    """
    problems = [kmeans1d.Problem(str(k), REVENUE, k) for k in range(1, most + 1)]
    fitted = kmeans1d.fit(frame, problems, max_iter=1000)
    rows = [(p.k, float(fitted[p.name].inertia)) for p in problems]
    return frame.sparkSession.createDataFrame(rows, "k long, sse double")


def trim_outliers(frame: DataFrame, quantile: float = 1) -> DataFrame:
    """Rows with revenue below the quantile; 1 leaves out the highest revenue."""
    threshold = exact_quantile(frame, REVENUE, quantile)
    return frame.filter(F.col(REVENUE) < F.lit(threshold))


def with_ltv_cluster(frame: DataFrame, clusters: int = 3) -> DataFrame:
    """Add the lifetime-value cluster, 0 for the lowest revenue."""
    fitted = kmeans1d.fit(frame, [kmeans1d.Problem(LABEL, REVENUE, clusters)], max_iter=1000)
    return frame.withColumn(LABEL, fitted[LABEL].rank())


def ltv_cluster_info(frame: DataFrame) -> DataFrame:
    """Mean revenue and number of customers of each cluster."""
    return (
        frame.groupBy(LABEL)
        .agg(F.avg(REVENUE).alias("Life Time Value (Revenue)"), F.count("*").alias("Customer Count"))
        .repartition(1)
        .sortWithinPartitions(LABEL)
    )


def feature_columns(frame: DataFrame, include_customer_id: bool = False) -> tuple[list[str], list[str]]:
    """Numeric and categorical features by type; dates and the label are neither."""
    left_out = {REVENUE, LABEL} | (set() if include_customer_id else {"customer"})
    numeric, categorical = [], []
    for field in frame.schema.fields:
        if field.name in left_out:
            continue
        if isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
        elif isinstance(field.dataType, T.StringType):
            categorical.append(field.name)
    return numeric, categorical


def missing_values(frame: DataFrame, columns: list[str]) -> int:
    """Number of missing cells in the columns."""
    cells = sum((F.col(f"`{c}`").isNull().cast("long") for c in columns), F.lit(0))
    return frame.agg(F.sum(cells)).first()[0] or 0


def most_frequent(frame: DataFrame, column: str) -> str | None:
    """The commonest value, the smallest on ties.

    Counted in groups: a mode aggregate would hold all distinct values in one task.
    """
    counted = frame.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), column).first()
    return None if top is None else top[column]


def numeric_as_double(frame: DataFrame, numeric: list[str]) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("double") for c in numeric})


def preprocessor(frame: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    """Fit imputation, scaling and encoding, which end in one ``features`` vector.

    Numbers: missing to the mean, then scaled to 0..1.  Text: missing to the
    commonest value, then one-hot; a value not seen here encodes as zeros.  There
    may be any number of values, as their dictionary is a table.
    """
    stages, parts = [], []
    if numeric:
        doubles = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `num_{i}`" for i, c in enumerate(numeric))
        stages.append(SQLTransformer(statement=f"SELECT *, {doubles} FROM __THIS__"))
        raw = [f"num_{i}" for i in range(len(numeric))]
        filled = [f"num_{i}_filled" for i in range(len(numeric))]
        stages += [
            Imputer(strategy="mean", inputCols=raw, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="numbers"),
            MinMaxScaler(inputCol="numbers", outputCol="scaled"),
        ]
        parts.append("scaled")
    if categorical:
        texts = []
        for i, c in enumerate(categorical):
            fill = (most_frequent(frame, c) or "").replace("\\", "\\\\").replace("'", "\\'")
            texts.append(f"coalesce(`{c}`, '{fill}') AS `cat_{i}`")
        names = [f"cat_{i}" for i in range(len(categorical))]
        stages += [
            SQLTransformer(statement=f"SELECT *, {', '.join(texts)} FROM __THIS__"),
            CategoryIndexer(inputCols=names, outputCols=[f"{n}_index" for n in names]),
            OneHotEncoder(
                inputCols=[f"{n}_index" for n in names],
                outputCols=[f"{n}_hot" for n in names],
                dropLast=True,
                handleInvalid="keep",
            ),
        ]
        parts += [f"{n}_hot" for n in names]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages).fit(frame)


def with_folds(frame: DataFrame, folds: int, label: str = LABEL, order: tuple = ("customer", "customer_segment")) -> DataFrame:
    """Add ``fold``, dealt out evenly within each label.

    Rows are numbered in the order of a digest of ``order``: within buckets that
    share its first digits, each of which continues where the one before it
    ended.  So no task numbers a whole label, and the folds do not depend on
    the number of rows.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in order]))
    bucketed = frame.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, FOLD_DIGITS))
    earlier = Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per label and bucket.
    offsets = (
        bucketed.groupBy(label, "bucket")
        .agg(F.count("*").alias("n"))
        .select(label, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    number = F.row_number().over(Window.partitionBy(label, "bucket").orderBy("digest", *order))
    numbered = bucketed.withColumn("number", number).join(offsets, [label, "bucket"])
    fold = F.pmod(F.col("offset") + F.col("number") - 1, F.lit(folds)).cast("int")
    return numbered.withColumn("fold", fold).drop("digest", "bucket", "number", "offset")
