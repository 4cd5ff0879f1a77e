"""Files: budgets, compaction, health, metric series of a hot tag, seeded buckets."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from trackyard.operators import order, stats
from trackyard.sources import io


def files(path):
    return sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_first_rows_opens_no_more_files(spark, tmp_path):
    path = f"{tmp_path}/a"
    spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    for n in (0, 1, 20, 21, 45, 100, 1000):
        found = io.first_rows(spark, path, n)
        assert [r.id for r in found.orderBy("path", "row_index").collect()] == list(range(min(n, 100)))
    # What is beyond the budget is not even a file of the plan, and may be anything.
    budget = io.first_rows(spark, path, 45)
    assert len(budget.inputFiles()) == 3
    names = files(path)
    stages = budget.select("id", "path")
    os.remove(names[4])
    assert stages.count() == 45


def test_first_rows_of_odd_folders(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    spark.range(3).where("id < 0").write.parquet(a)
    assert io.first_rows(spark, a, 5).columns == ["id", "path", "row_index"] and io.first_rows(spark, a, 5).count() == 0
    spark.range(6).withColumn("s", F.concat(F.lit("a b/"), (F.col("id") % 2).cast("string"))).repartition("s").sortWithinPartitions("id").write.partitionBy("s").parquet(b)
    found = io.first_rows(spark, b, 4).orderBy("path", "row_index").collect()
    assert [(r.id, r.s) for r in found] == [(0, "a b/0"), (2, "a b/0"), (4, "a b/0"), (1, "a b/1")]


def test_first_kept_reads_runs_of_files(spark, tmp_path):
    path = f"{tmp_path}/a"
    spark.range(400).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    for odd, n in ((3, 0), (3, 1), (3, 20), (3, 21), (3, 133), (3, 134), (3, 500), (401, 5), (1, 40)):
        found = io.first_kept(spark, path, n, F.col("id") % odd == odd - 1)
        assert [r.id for r in found.orderBy("path", "row_index").collect()] == [k for k in range(400) if k % odd == odd - 1][:n]
    assert len(io.first_kept(spark, path, 20, F.col("id") % 3 == 2).inputFiles()) <= 5
    caps = io.capped_sources(spark, {"a": path, "b": path}, {"a": 0.1}, F.col("id") % 2 == 0)
    assert {r.source: r["count"] for r in caps.groupBy("source").count().collect()} == {"a": 40, "b": 200}


def test_compaction_by_bytes(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    rng = random.Random(1)
    spark.createDataFrame([(k, rng.random()) for k in range(20_000)], "k int, x double").repartition(60).write.parquet(a)
    total = sum(os.path.getsize(f) for f in files(a))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert io.compact_folder(spark, a, b, total // 5) == 5
    sizes = [os.path.getsize(f) for f in files(b)]
    assert len(sizes) == 5 and max(sizes) <= 1.2 * sum(sizes) / 5 and min(sizes) >= 0.8 * sum(sizes) / 5
    assert sorted(map(tuple, spark.read.parquet(b).collect())) == sorted(map(tuple, spark.read.parquet(a).collect()))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert io.compact_folder(spark, a, f"{tmp_path}/c", 10 * total) == 1


def test_every_bad_file_is_told(spark, tmp_path):
    path = f"{tmp_path}/a"
    rng = random.Random(2)
    spark.createDataFrame([(k, rng.random(), "x" * (k % 7)) for k in range(8000)], "k int, x double, s string").repartition(5).write.option("compression", "none").parquet(path)
    names = files(path)
    with open(names[0], "r+b") as f:  # a footer that is cut off
        f.truncate(os.path.getsize(names[0]) - 20)
    with open(names[3], "r+b") as f:  # a page with wrong bytes at its head
        f.seek(4)
        f.write(b"\xff" * 60)
    found = {r.file.split("/")[-1]: r for r in io.file_health(spark, path).collect()}
    assert [found[os.path.basename(n)].ok for n in names] == [False, True, True, False, True]
    assert found[os.path.basename(names[0])].error == "no footer can be read" and "rows can be read" in found[os.path.basename(names[3])].error
    (r,) = io.dataset_health(spark, [path]).collect()
    assert (r.ok, r.n_files, r.n_bad) == (False, 5, 2) and r.error == "no footer can be read"


def test_folders_without_a_good_file(spark, tmp_path):
    os.makedirs(f"{tmp_path}/a")
    for k in range(2):
        open(f"{tmp_path}/a/{k}.parquet", "w").write("no Parquet at all")
    assert [(r.ok, r.n_rows, r.error) for r in io.file_health(spark, f"{tmp_path}/a").collect()] == [(False, None, "no footer can be read")] * 2
    spark.range(0).write.parquet(f"{tmp_path}/b")
    rows = {r.dataset.split("/")[-1]: r for r in io.dataset_health(spark, [f"{tmp_path}/{x}" for x in "abc"]).collect()}
    assert rows["a"].n_bad == 2 and not rows["a"].ok and rows["b"].ok and not rows["c"].ok and rows["c"].error


def test_a_hot_tag_is_many_files(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 100 == 0, "b/c").otherwise("hot/tag").alias("tag"), (4000 - F.col("id")).alias("step"), F.lit(1.0).alias("wall_time"), F.col("id").cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        io.write_metric_series(rows, f"{tmp_path}/m")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = sorted(glob.glob(f"{tmp_path}/m/series/tag=hot__tag/*.csv"))
    assert len(hot) >= 3
    steps = [int(line.split(",")[0]) for f in hot for line in open(f).read().split("\n")[1:] if line]
    assert steps == sorted(steps) and len(steps) == 3960
    back = io.read_metric_series(spark, f"{tmp_path}/m/series")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_buckets_are_one_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "test").when(F.col("id") != 7, "train").alias("split"))
    orders = []
    for n in (1, 3, 11):
        counts = io.write_training_set(df, f"{tmp_path}/{n}", seed=3, buckets=n)
        assert {r.split: r.rows for r in counts.collect()} == {"none": 1, "test": 100, "train": 399}
        rows = spark.read.parquet(f"{tmp_path}/{n}/rows").select("event_id", "split", "_metadata.file_name", "_metadata.row_index").collect()
        orders.append([(r.split, r.event_id) for r in sorted(rows, key=lambda r: (r.split, r.file_name, r.row_index))])
        assert sum(r.rows for r in spark.read.parquet(f"{tmp_path}/{n}/buckets").collect()) == 500
    assert orders[0] == orders[1] == orders[2] != sorted(orders[0])
    plan = order.shuffle(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan


def test_small_operators(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "event_id long, pt array<double>")
    assert [tuple(r) for r in order.local_index(df, "pt").collect()] == [(1, 0, 1.0), (1, 1, 2.0)]
    nested = spark.createDataFrame([(1, [(5.0,), (6.0,)])], "event_id long, jets array<struct<pt: double>>")
    assert [tuple(j) for j in order.with_local_index(nested).first().jets] == [(5.0, 0), (6.0, 1)]
    w = spark.createDataFrame([(x,) for x in (-2.0, -1.0, -0.96, 0.0, 1.0, 1.5, float("nan"), None)], "weight double")
    assert sorted(((r.bin, r.events) for r in stats.weight_histogram(w).collect()), key=str) == [(-1, 1), (0, 1), (1, 1), (25, 1), (49, 1), (50, 1), (None, 2)]
    u = spark.createDataFrame([("a", [(1,), (-1,)], 1.0), ("a", [], -3.0), ("a", None, 3.0), ("b", [], -1.0)], "s string, jets array<struct<prov: int>>, weight double")
    assert sorted(map(tuple, stats.unmatched_fraction(u, ["s"]).collect())) == [("a", 0.5, 2.0), ("b", None, None)]
    h = stats.multiplicity(df, [], F.size("pt"))
    assert [tuple(r) for r in stats.exact_quantiles(h, [], {"q": 0.5}).collect()] == [(1.0,)]
    with pytest.raises(ValueError):
        io.read_events(spark, ["a.csv"])


def test_tables_are_removed_by_the_thread_that_made_them(spark):
    from threading import Thread

    from trackyard.sources import tables

    since, others = tables.mark(), []
    mine, kept = tables.cut(spark.range(3)), tables.cut(spark.range(4))
    other = Thread(target=lambda: others.append(tables.cut(spark.range(5))))
    other.start()
    other.join()
    tables.drop_since(spark, since, kept)
    assert kept.count() == 4 and others[0].count() == 5 and tables.mark() == since + 1
    assert not os.path.exists(mine.inputFiles()[0].removeprefix("file://"))


def test_split_by_a_narrow_table_of_keys(spark):
    wide = spark.range(103).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("source"), F.array_repeat("id", 5).alias("payload"))
    one = order.train_test_split(wide, "source")
    two = order.train_test_split(wide, "source", keys=wide.select("source", "event_id"))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
