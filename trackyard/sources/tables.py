"""A shared folder for tables that a plan writes and reads again."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table that are sent to all tasks.
SMALL = 100_000

_local: list[str] = []
_of_thread = threading.local()


def written() -> list[str]:
    """The folders that this thread of the driver has named so far, in order; other threads have lists of their own, so that one operator does not remove the tables of another."""
    if not hasattr(_of_thread, "paths"):
        _of_thread.paths = []
    return _of_thread.paths


def workspace(spark: SparkSession, tag: str = "table") -> str:
    """A new folder name under ``spark.checkpoint.dir``; on a local master without that setting, under a temporary folder.

    :func:`drop_since` removes folders that nothing reads any more; the others are left to the clean-up of the shared folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-"))
        root = f"file://{_local[0]}"
    written().append(path := f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return path


def mark() -> int:
    """How many folders this thread has named, for :func:`drop_since`."""
    return len(written())


def drop_since(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Remove the folders named after :func:`mark` gave ``since``, but for those that ``keep`` reads: its own rows are in files by then."""
    held = "\n".join(keep.inputFiles()) if keep is not None else ""
    for path in [p for p in written()[since:] if p.rsplit("/", 1)[1] not in held]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        written().remove(path)


def cut(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its rows and their order in files are fixed from here."""
    path = workspace(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, tag: str = "table") -> DataFrame:
    """A lookup table for a join: written, counted, and sent to all tasks if it has at most :data:`SMALL` rows; the other side is then not shuffled.

    A larger one is joined by shuffling, and Spark splits skewed keys.
    """
    df = cut(df, tag)
    return F.broadcast(df) if df.count() <= SMALL else df
