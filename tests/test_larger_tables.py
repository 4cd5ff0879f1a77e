"""What shows only in larger tables: rare values, and work that grows faster than its input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from trackyard import registry
from trackyard.operators import joins
from trackyard.plans import views as V
from trackyard.sources import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def duck(d, *tables):
    """The small tables, but for those that ``d`` holds."""
    c = connect(SF)
    for t in tables:
        c.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return c


def test_log_of_a_float_next_to_an_edge(spark, tmp_path):
    """Logarithms of these prices lie below an edge of the query's cells, and on it once they are floats."""
    prices = [5352.34, 5806.45, 7637.24, 9638.09, 10240.26, 11558.61, 11675.78, 12156.36]
    price = F.element_at(F.array(*map(F.lit, prices)), (F.col("l_orderkey") % len(prices) + 1).cast("int"))
    V.table(spark, SF, "lineitem").where("l_linenumber = 1").withColumn("l_extendedprice", price).write.parquet(f"{tmp_path}/lineitem.parquet")
    V.table(spark, SF, "orders").write.parquet(f"{tmp_path}/orders.parquet")
    name = "t14_log_normalize"
    same(registry.QUERIES[name](spark, str(tmp_path)), duck(tmp_path, "lineitem", "orders").sql(registry.ORACLE_SQL[name]))


def _random_counts(spark):
    rng = np.random.default_rng(3)
    big = rng.integers(3_000_000, 3_100_000, 60)
    a, b = [int(x) for x in [*rng.integers(-3000, 9000, 300), *big, 9_999_950, 0]], [int(x) for x in [*rng.integers(-3000, 9000, 90), *(big[:40] + rng.integers(-45, 45, 40)), 10_000_000]]
    return a, b, spark.createDataFrame([*enumerate(a), (len(a), None)], "dataset long, n_events long"), spark.createDataFrame([*enumerate(b), (len(b), None)], "sample long, n long")


def test_counts_without_a_sample_need_no_pairs(spark):
    a, b, counts, flow = _random_counts(spark)
    want = [i for i, x in enumerate(a) if not any(abs(x - y) <= 5 + 1e-5 * abs(y) for y in b)] + [len(a)]
    assert 20 < len(want) < len(a) - 20
    assert sorted(r["dataset"] for r in joins.without_sample(counts, flow).collect()) == want
    # 40,000 rows make 400 million pairs, of which none is made.
    same = spark.range(20_000)
    rows = joins.without_sample(same.select(F.col("id").alias("dataset"), F.lit(7).cast("long").alias("n_events")), same.select(F.col("id").alias("sample"), F.lit(9).cast("long").alias("n")))
    assert rows.count() == 0 and "CartesianProduct" not in rows._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        joins.without_sample(counts, flow, relative=1)


def test_pairs_of_equal_counts_are_spread_over_tasks(spark, monkeypatch):
    """Two hot counts: no task gets more than a few blocks of them, and no pair is lost or doubled."""
    _, _, counts, flow = _random_counts(spark)
    counts = counts.union(spark.range(1000, 1300).select("id", (F.col("id") % 2 * 3 + 5000).alias("n_events")))
    flow = flow.union(spark.range(1000, 1200).select("id", F.lit(5004).cast("long").alias("n")))
    monkeypatch.setattr(joins, "BLOCK", 20)
    monkeypatch.setattr(joins, "PAIRS", 4000)
    found = joins.resolve_sample(counts, flow)
    close = F.abs(F.col("n_events") - F.col("n")) <= 5 + 1e-5 * F.abs(F.col("n"))
    want = counts.crossJoin(flow).where(close)
    assert found.count() == want.count() and found.exceptAll(want.select(*found.columns)).count() == 0
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 10 and max(tasks) < found.count() / 5


@pytest.mark.parametrize("name", ["r1_multiplicity_stream", "r1_resumed_stream"])
def test_arriving_files_are_as_many_as_tasks(spark, monkeypatch, name):
    """Nested events are written where they lie, so a task writes no fixed share of all of them; there are several files even of one task."""
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    monkeypatch.setattr(tables, "workspace", lambda own, tag="table", made=tables.workspace: found.append(made(own, tag)) or found[-1])
    try:
        for parts in ("1", "12"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found.clear()
            same(registry.QUERIES[name](spark, SF), connect(SF).sql(registry.ORACLE_SQL[name]))
            files = spark.read.parquet(found[0])
            assert len(files.inputFiles()) >= (12 if parts == "12" else 3)
            assert files.count() == V.events(spark, SF).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_capped_sources_count_jets_once(spark, tmp_path, monkeypatch):
    """Nothing is nested to count jets, object rows are read by one table that is written, and a sample or all may be without events."""
    made = []
    monkeypatch.setattr(V, "nested", lambda *_: pytest.fail("jets were nested"))
    monkeypatch.setattr(V, "jet_counts", lambda *a, own=V.jet_counts: made.append(a) or own(*a))
    name = "w2_capped_sources"
    for k, kept in enumerate(["true", "o_orderpriority <> '2-HIGH'", "false"]):
        d = f"{tmp_path}/{k}"
        V.table(spark, SF, "orders").where(kept).write.parquet(f"{d}/orders.parquet")
        V.table(spark, SF, "lineitem").write.parquet(f"{d}/lineitem.parquet")
        same(registry.QUERIES[name](spark, d), duck(d, "lineitem", "orders").sql(registry.ORACLE_SQL[name]))
    assert len(made) == 3
