"""Tables in the folder that driver and executors share.

Intermediate results that several plans read are written once as Parquet under
``spark.checkpoint.dir`` and read back, which also cuts lineage: a lost
executor costs the tasks it ran, never a recomputation of earlier steps.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(run):
    """``run`` for mapInArrow, which at its end gives freed memory back to the system: Python workers live on between tasks."""

    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where the session has no such setting (tests on one machine) a temporary
    local folder is used; a cluster always names its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'gridwarden-shared')}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting that makes joins shuffle even where the rows lie together by some of the keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings of the session for queries that run inside; then those of before."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back; with ``tidy`` the shuffle files of this step go at its end."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(spark, {TIDY: "true"} if tidy else {}):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Delete tables that ``materialise`` made and nothing will read again; a text after a table names the one partition of it that goes."""
    for df, part in zip(tables, [*tables[1:], None]):
        if isinstance(df, str):
            continue
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at + (f"/{part}" if isinstance(part, str) else ""))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
