"""Data selection by importance resampling.

Text is seen as a bag of hashed word unigrams and bigrams.  Two generative
models over the buckets, one of target text and one of raw text, give each
document the log-likelihood ratio as its importance weight.  Adding Gumbel
noise and keeping the largest keys samples without replacement in proportion
to the weights.

The raw model counts every document.  The target model is fitted on at most
``sample`` documents that the labels call good, chosen by a hash of the id.
Models have a fixed number of buckets, so what is broadcast does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches, table, whole_text, written
from .kernels import U, WordHasher, document_blocks, rolled, text_buffers

BUCKET_BITS = 16
SAMPLE = 8192
SHARE = 0.5
SEED = 11
# Rows that the driver may order to find the key at a rank.
AT_ONCE = 50_000


def document_buckets(column, hasher, bits):
    """(row, buckets of its unigrams and bigrams) of each text of a batch."""
    data, offs = text_buffers(column)
    for i, j in document_blocks(offs, 1 << 19):
        hashes, _, _, first = hasher.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        pairs = rolled(hashes, 2)
        shift = U(64 - bits)
        one, two = (hashes >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            yield i + d, np.concatenate([one[a:b], two[a : max(a, b - 1)]])


def bucket_counts(rows: DataFrame, bits: int) -> np.ndarray:
    """Counts per bucket and kind of the rows (target, text): kind 0 is all text, kind 1 target text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, summed = WordHasher(lower=True), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False)
            for row, buckets in document_buckets(batch.column(1), hasher, bits):
                counts = np.bincount(buckets, minlength=1 << bits)
                summed[0] += counts
                if target[row]:
                    summed[1] += counts
        kind, bucket = np.nonzero(summed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(bucket), pa.array(summed[kind, bucket])], names=["kind", "bucket", "n"]
        )

    found = rows.mapInArrow(count, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 1 << bits))
    out[found.column("kind").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, bits: int) -> np.ndarray:
    """log P(target) - log P(raw) of each bucket, both with one count added."""
    good = labels.where(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct()
    good = good.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).withColumn("target", F.lit(True))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(good), "id", "left")
    counts = bucket_counts(rows.select(F.coalesce("target", F.lit(False)).alias("target"), "text"), bits) + 1
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0] if counts[1].sum() > counts.shape[1] else np.zeros(counts.shape[1])


def weight_of(ratio: np.ndarray, spark, bits: int):
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weight(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, values = WordHasher(lower=True), shared.value
        for column in columns:
            out = np.zeros(len(column))
            for row, buckets in document_buckets(column, hasher, bits):
                out[row] = values[buckets].sum()
            yield pa.array(out)

    return weight


def gumbel(id_col: Column, seed: int) -> Column:
    """The same noise for the same id, so a recomputed row keeps its key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def key_at_rank(keys: DataFrame, rank: int) -> float | None:
    """The ``rank``-th largest of the column ``key``, by counting in ever narrower ranges."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or rank <= 0:
        return None
    rank = min(rank, n)
    inside, above = n, 0  # rows in [low, high], rows above it
    parts = 4096
    while inside > AT_ONCE and low < high:
        step = (high - low) / parts
        slot = F.least(F.floor((F.col("key") - low) / step), F.lit(parts - 1)).cast("int")
        found = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(slot.alias("slot"))
        counts = found.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("slot")).collect()
        before = inside
        for c in counts:
            if above + c.n >= rank:
                low, high, inside = c.low, c.high, c.n
                break
            above += c.n
        if inside == before:
            break
    if low == high:
        return low
    rest = keys.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(F.desc("key")).limit(rank - above)
    return rest.agg(F.min("key")).first()[0]


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    bits: int = BUCKET_BITS,
    seed: int = SEED,
) -> DataFrame:
    """(id, log_weight, key) of the sampled rows: ``share`` of all rows, rounded up.

    Rows whose key ties with the last one sampled are sampled too, so repeated
    rows stay together.  Null and empty texts have weight zero; without good
    labels all weights are zero and the sample is uniform; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    weight = weight_of(log_ratio(docs, labels, id_col, text_col, label_col, sample, bits), spark, bits)
    keyed = docs.select(F.col(f"`{id_col}`"), weight(whole_text(text_col)).alias("log_weight"))
    noise = gumbel(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), seed)
    keyed = written(keyed.withColumn("key", F.col("log_weight") + noise), "importance")
    last = key_at_rank(keyed, int(-(-keyed.count() * share // 1)))
    return keyed.where(F.lit(False) if last is None else F.col("key") >= last)


def op9_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
