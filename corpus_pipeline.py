"""A pipeline that prepares ``documents`` for training.

Each stage takes (spark, docs, sf_dir).  The filtering stages return the rows
that stay with the columns they came with; the last one returns, for each
document that is left, its number of tokens and the digests of its token ids
and of the bytes decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronage.llm.byte_bpe import digests
from patronage.llm.common import table, written
from patronage.llm.decontaminate import drop_leaks
from patronage.llm.exact_dedup import drop_exact_copies
from patronage.llm.near_dedup import drop_near_copies
from patronage.llm.toxicity import drop_toxic


# The encoder shares its executors with what earlier stages have left there.
ENCODER_MEMORY = 96 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, the one with the largest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near copies (five-word shingles, 0.8), the one with the smallest id."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return digests(docs, memory=ENCODER_MEMORY, lasting=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

# A fitted model and an edit distance have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
