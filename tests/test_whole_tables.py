"""Operators over whole tables, beyond the rows that their queries or the reference look at."""

import hashlib
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackyard.operators import evaluate, joins, order, prefix
from trackyard.sources import io, tables


def test_stable_metric_order_breaks_ties(spark):
    df = spark.range(1000, 0, -1).select(F.col("id").alias("event_id"), F.lit("t").alias("tag"), (F.col("id") % 3).alias("step"), F.lit(0.0).alias("wall_time"))
    got = [(r["step"], r["event_id"]) for r in order.stable_metric_order(df).collect()]
    assert got == sorted((k % 3, k) for k in range(1, 1001))


def test_shuffle_places_every_row(spark):
    got = [r["event_id"] for r in order.shuffle(spark.range(2000).withColumnRenamed("id", "event_id"), 7).collect()]
    assert got == sorted(range(2000), key=lambda k: hashlib.md5(b"7-%d" % k).hexdigest())


def test_written_training_set_is_shuffled(spark):
    """Files of a split, in order of name, hold its rows in the seeded order, whatever the plan before."""
    rows = spark.range(3000).withColumnRenamed("id", "event_id").withColumn("split", F.when(F.col("event_id") % 5 == 0, "test").otherwise("train"))
    rows = rows.join(rows.select("event_id", (F.col("event_id") * 2).alias("x")), "event_id")
    path = tables.workspace(spark)
    io.write_training_set(rows, path, seed=7)
    found = spark.read.parquet(f"{path}/rows").select("split", "event_id", "_metadata.file_name", "_metadata.row_index").collect()
    for split in ("train", "test"):
        got = [r["event_id"] for r in sorted((r for r in found if r["split"] == split), key=lambda r: (r["file_name"], r["row_index"]))]
        assert got == sorted((k for k in range(3000) if (k % 5 == 0) == (split == "test")), key=lambda k: hashlib.md5(b"7-%d" % k).hexdigest())


def test_last_value_over_parts(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 97 < 3, F.col("id")).alias("v"))
    last, want = {}, {}
    for k in range(500):
        last[k % 3] = k if k % 97 < 3 else last.get(k % 3)
        want[k] = last[k % 3]
    assert {r["k"]: r["out"] for r in prefix.running_last(df, ["k"], "v", "out", ["g"]).collect()} == want


def test_unresolved_datasets_are_errors(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 5_000_000)], "dataset string, n_events long")
    flow = spark.createDataFrame([("x", 1003)], "sample string, n long")
    found = joins.resolve_sample(counts, flow)
    assert [r["dataset"] for r in joins.unresolved(counts, found).collect()] == ["b"]
    with pytest.raises(PySparkException):
        joins.require_resolved(counts, found).collect()


def test_uneven_histograms_are_errors(spark):
    h = spark.createDataFrame([(0, 1.0), (1, 1.05)], "bin int, value double")
    assert evaluate.require_uniform(h, 2, 0.1).count() == 1
    with pytest.raises(PySparkException):
        evaluate.require_uniform(h, 2, 0.01).collect()


def test_queries_can_be_imported_first():
    subprocess.run([sys.executable, "-c", "import trackyard.plans.event_queries, trackyard.registry"], check=True)
