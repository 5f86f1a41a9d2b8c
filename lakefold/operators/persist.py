"""Caching, reliable checkpoints, paths below the shared folder, and counters."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

LEVELS = {"MEMORY_ONLY": StorageLevel.MEMORY_ONLY, "DISK_ONLY": StorageLevel.DISK_ONLY, "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK, "NONE": StorageLevel.NONE}


@contextmanager
def cached(df: DataFrame, level: str = "MEMORY_AND_DISK"):
    """df kept at a level inside the block; NONE keeps nothing. An empty frame is kept like others."""
    if level == "NONE":
        yield df
        return
    df.persist(LEVELS[level])
    try:
        yield df
    finally:
        df.unpersist()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which all executors see; where it is unset, as in tests, a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakefold-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it; file:/x, as Hadoop writes it, is file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; nulls, repeats and an empty frame come back as they were."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def compute_counter(spark: SparkSession):
    """An accumulator that per-partition code may raise, to see how often it runs."""
    return spark.sparkContext.accumulator(0)
