"""Shared helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a session in one JVM that names none gets a temporary folder; on a
    cluster that would not be shared, so there the setting is required.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="patronage-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


# Rows of a narrow table that one task writes, about.
FILE_ROWS = 200_000


def files(rows: int) -> int:
    """Files for a narrow table of at most so many rows."""
    return -(-max(rows, 1) // FILE_ROWS)


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, survives executors.

    Each call writes to a path of its own; the folder's owner clears it.  Where
    a bound of the rows is known, ``parts`` keeps a small table from being
    scattered over a file of a few rows for every shuffle partition.
    """
    if parts is not None:
        df = df.coalesce(parts)
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session to ``rows`` rows; smaller settings stay.

    Texts may be long, and a batch is held in the executor's JVM and in Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def whole_text(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass
