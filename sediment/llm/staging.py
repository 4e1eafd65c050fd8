"""Intermediate tables in the folder that driver and executors share.

Long jobs cut their lineage by writing a Parquet table under ``spark.checkpoint.dir``
and reading it back, so a lost executor costs the tasks it ran and no more. Where the
setting is absent (tests), the warehouse folder serves instead; it is shared too.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The root of this application's intermediate tables and files, as a URI or path."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_staging"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/sediment-{spark.sparkContext.applicationId}")
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()  # a path without a scheme means the default file system, for Python workers too
    return full.replace("file:/", "file:///", 1) if re.match("file:/[^/]", full) else full


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(fs_path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and return the written table; an empty frame gives an empty table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and shuffle files nobody refers to."""
    for df in staged:
        path = getattr(df, "staged_path", None)
        if path:
            spark = df.sparkSession
            fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)
    release(staged[0].sparkSession) if staged else None


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """The shuffle width that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Send at most `rows` rows at once to Python workers meanwhile: whole texts and sets are wide, and workers hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hand_back() -> None:
    """Return this process's freed memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


kept_caches: list[dict] = []  # of this worker process: what operators keep from task to task


def lean(run: Callable, keep: bool = False) -> Callable:
    """`run` for mapInArrow, handing back memory when a task ends: workers live on, and what they hold comes on top of what the executor's heap needs next.

    Unless `keep`, caches that another operator's tasks left in this worker go first.
    """

    def task(batches):
        if not keep and any(kept_caches):
            for cache in kept_caches:
                cache.clear()
            hand_back()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task
