"""Multiplicity counts over arriving event files, kept in a durable state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackyard.operators.stats import multiplicity


def _versions(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the batches whose state has been committed under ``state``, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/counts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/counts/{n}/_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold_multiplicity(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], count: Column, state: str, files: int = 1000) -> int:
    """Add the event files under ``path`` that no earlier call has read to the counts under ``state``, and return the rows read.

    The stream's checkpoint lies in ``state``, so a file is read once over all calls. Each micro-batch of at most ``files`` files is counted and merged with the counts of the batch before into a folder of its own number, in place of
    what a failed try has left there: a batch that Spark repeats after a loss merges with the same earlier counts, and changes nothing. The counts of the last two batches are kept. Batches without files leave the counts as they are.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        fresh = multiplicity(rows, keys, count)
        before = [v for v in _versions(own, state) if v < batch]
        if before:
            fresh = own.read.parquet(f"{state}/counts/batch={before[-1]}").unionByName(fresh).groupBy(*keys, "n").agg(F.sum("events").alias("events"))
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{state}/counts/batch={batch}")
        for v in before[:-1]:
            _drop(own, f"{state}/counts/batch={v}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def multiplicity_state(spark: SparkSession, state: str) -> DataFrame:
    """The counts (keys, n, events) of all files that have been folded in; an error before the first."""
    versions = _versions(spark, state)
    if not versions:
        raise ValueError(f"no counts in {state}")
    return spark.read.parquet(f"{state}/counts/batch={versions[-1]}")


def multiplicity_stream(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], count: Column, state: str, files: int = 1000) -> DataFrame:
    """Counts by key and multiplicity of all event files under ``path``, those of earlier calls from ``state``."""
    fold_multiplicity(spark, path, schema, keys, count, state, files)
    return multiplicity_state(spark, state)
