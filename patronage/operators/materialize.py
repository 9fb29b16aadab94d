"""Cut points for frames that several later jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel


def checkpoint_dir_ready(spark) -> bool:
    """Whether reliable checkpoints can be written: to the folder in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return True
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        return False
    sc.setCheckpointDir(configured)
    return True


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once; the result survives the loss of executors.

    Written to the checkpoint folder where there is one.  Otherwise persisted,
    in which case lost blocks are recomputed from the source, and ``release``
    frees them.
    """
    if checkpoint_dir_ready(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint where there is a folder for it; else ``df``, computed anew by each reader, so that nothing stays cached."""
    return df.checkpoint(eager=True) if checkpoint_dir_ready(df.sparkSession) else df


def release(*frames: DataFrame | None) -> None:
    """Free frames that were persisted; checkpoints belong to their folder."""
    for df in frames:
        if df is not None and df.storageLevel != StorageLevel.NONE:
            df.unpersist()


# Rows for which a task of its own is worth while.
TASK_ROWS = 1024


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly to as many tasks as run at once, fewer if there are few rows.

    For rows that are read again and again, whose last shuffle may have left
    them in a few partitions.
    """
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)))
    return df.repartition(parts)
