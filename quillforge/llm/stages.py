"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's spark.checkpoint.dir; only where none is set and driver and executors are
    one process (tests) a temporary one is made. Elsewhere a folder of one machine would not do, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillforge-"))
    return context.getCheckpointDir()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing refers to any more.

    Its cleaner waits for the driver's garbage collection, which a mostly idle driver puts off while a job of many
    steps fills the disks with what earlier steps have shuffled.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a stage wrote, in whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows to a file, about, where a result's size is known beforehand.
FILE_ROWS = 200_000


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once and read from the checkpoint folder from then on.

    Where it has about ``rows`` rows, it is written to a file for each ``FILE_ROWS`` of them, not to one for each partition: the many small
    results of a loop would else be thousands of files.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint(eager=True)
