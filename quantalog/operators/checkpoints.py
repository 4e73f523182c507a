"""Tables in the folder that driver and executors share: lineage is cut there, and lost executors cost nothing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that tables are written to within `scratch`, if any.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)
#: Whether shuffle files go as soon as what made them is over; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, if driver and executors are one process (tests)."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quantalog-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_SCRATCH.get() or f'{shared_folder(spark)}/quantalog'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at its end, and shuffle files after each query. What is to stay is written to a path made before."""
    at, before = shared_path(spark, "scratch"), spark.conf.get(CLEANUP, None)
    inside = _SCRATCH.set(at)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        _SCRATCH.reset(inside)
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        removed(spark, at)


def written(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """df as a Parquet table in the shared folder, computed once."""
    path = path or shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def dealt(df: DataFrame, rows: int, most: int, *keys: str) -> DataFrame:
    """df of so many rows, dealt by its keys, `most` rows or so to a task, whatever the number of shuffle partitions is set to."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)


def sent(df: DataFrame, name: str, most: int) -> DataFrame:
    """df, written once and sent to every task if it has `most` rows or fewer; a larger one is left to be joined by a shuffle."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= most else table
