"""Models of several inputs, slices that resume, complete scores, quantile tables of any size, streams that go on."""

import math
import os
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackyard.operators import joins, scoring
from trackyard.streaming.multiplicity import fold_multiplicity, multiplicity_state

FEED = {"jets": "jets", "mask": "mask", "event": "event"}
ROWS = "event_id long, jets array<array<double>>, mask array<boolean>, event array<double>"


def counted():
    """A scorer that tells the shape of its batch and the sum of its masked jets."""

    def scorer(feed):
        n = len(feed["event"])
        assert feed["jets"].shape == (n, 3, 2) and feed["mask"].shape == (n, 3) and feed["event"].shape == (n, 1)
        return np.stack([(feed["jets"].sum(axis=2) * feed["mask"]).sum(axis=1), np.full(n, n), feed["event"][:, 0]], axis=1)

    return scorer


def events(spark, n):
    return spark.createDataFrame([(k, [[float(k), 1.0]] * 3, [True, k % 2 == 0, False], [float(k)]) for k in range(n)], ROWS)


def test_tensor():
    a = pa.array([[[1.0, 2.0]], [[3.0, 4.0]], [[5.0, 6.0]]])
    assert scoring.tensor(a.slice(1)).tolist() == [[[3.0, 4.0]], [[5.0, 6.0]]] and scoring.tensor(a).base is not None
    assert scoring.tensor(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None], [[1.0, None], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            scoring.tensor(pa.array(bad, pa.list_(pa.float64())))


def test_all_rows_and_the_last_batch(spark):
    found = scoring.score_inputs(events(spark, 11).coalesce(1), counted, FEED, batch=4).orderBy("event_id").collect()
    assert [r.scores[1] for r in found] == [4.0] * 8 + [3.0] * 3
    assert [r.scores[0] for r in found] == [(k + 1.0) * (2 if k % 2 == 0 else 1) for k in range(11)]
    assert scoring.score_inputs(events(spark, 3).limit(0), counted, FEED).collect() == []


def test_rows_of_other_shapes_are_errors(spark):
    ragged = spark.createDataFrame([(1, [[1.0, 1.0]] * 3, [True] * 3, [1.0]), (2, [[1.0, 1.0]] * 2, [True] * 3, [1.0])], ROWS).coalesce(1)
    with pytest.raises(Exception, match="different shapes"):
        scoring.score_inputs(ragged, counted, FEED).collect()


def test_masked_linear_without_objects(spark):
    net = scoring.masked_linear(np.ones((2, 2)), np.zeros((1, 2)), np.array([0.0, 1.0]), "jets", "mask", "event")()
    out = net({"jets": np.ones((1, 3, 2)), "mask": np.zeros((1, 3), bool), "event": np.ones((1, 1))})
    assert np.allclose(out, [[1 / (1 + math.e), math.e / (1 + math.e)]])


# --- slices


def scores(df):
    return sorted((r.event_id, r.scores[0], r.slice) for r in df.collect())


def test_slices_are_taken_up(spark, tmp_path):
    df, whole, half = events(spark, 23), f"{tmp_path}/a", f"{tmp_path}/b"
    assert scoring.score_slices(df, counted, FEED, whole, 4) == [0, 1, 2, 3]
    assert scoring.score_slices(df, counted, FEED, half, 4, most=2) == [0, 1]
    with pytest.raises(ValueError, match=r"missing slices.*\[2, 3\]"):
        scoring.merged_slices(spark, half)
    # A slice that was ended before its commit is scored anew.
    os.makedirs(f"{half}/scores/slice=2")
    open(f"{half}/scores/slice=2/part-00000.parquet", "w").write("cut off")
    before = os.stat(f"{half}/scores/slice=0/_SUCCESS").st_mtime_ns
    assert scoring.score_slices(df, counted, FEED, half, 4) == [2, 3] and scoring.score_slices(df, counted, FEED, half, 4) == []
    assert os.stat(f"{half}/scores/slice=0/_SUCCESS").st_mtime_ns == before
    assert scores(scoring.merged_slices(spark, half)) == scores(scoring.merged_slices(spark, whole))
    assert [r.n_rows for r in spark.read.parquet(f"{half}/manifest").orderBy("slice").collect()] == [5, 6, 6, 6]


def test_doubled_and_other_slices_are_errors(spark, tmp_path):
    df, path = events(spark, 12), f"{tmp_path}/a"
    scoring.score_slices(df, counted, FEED, path, 3)
    own = f"{path}/scores/slice=1"
    for f in [x for x in os.listdir(own) if x.endswith(".parquet")]:
        shutil.copy(f"{own}/{f}", f"{own}/again-{f}")
    with pytest.raises(ValueError, match="1 has 8 of 4 rows"):
        scoring.merged_slices(spark, path)
    with pytest.raises(ValueError, match="other events"):
        scoring.score_slices(events(spark, 13), counted, FEED, path, 3)


def test_one_event_and_many_jobs(spark, tmp_path):
    assert scoring.score_slices(events(spark, 2), counted, FEED, f"{tmp_path}/a", 9) == [0, 1]
    assert len(scoring.merged_slices(spark, f"{tmp_path}/a").collect()) == 2


# --- scores of events


def test_scores_once_for_each_event(spark):
    ev = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "event_id long, sample string")
    sc = lambda *k: spark.createDataFrame([(x, [float(x)]) for x in k], "event_id long, scores array<double>")
    assert sorted((r.event_id, r.has_score, r.scores) for r in joins.attach_scores(ev, sc(1, 2)).collect()) == [(1, True, [1.0]), (2, True, [2.0]), (3, False, None)]
    assert joins.attach_scores(ev, sc(3, 2, 1), complete=True).count() == 3
    for rows, options, message in ((sc(1, 2, 3, 2), {}, "event 2 has scores 2 times"), (sc(1, 2), {"complete": True}, "event 3 has no scores"), (sc(1, 2, 3, 4), {"complete": True}, "scores of no event 4")):
        with pytest.raises(Exception, match=message):
            joins.attach_scores(ev, rows, **options).count()


# --- quantiles


@pytest.mark.parametrize("output", ["uniform", "normal"])
def test_both_sides_of_the_bound(spark, output):
    table = spark.createDataFrame([(k, q, k / 6) for k, q in enumerate([0.1, 0.2, 0.2, 0.2, 0.5, 0.7, 0.9])], "k int, quantile double, reference double")
    xs = [None, float("nan"), -1.0, 0.1, 0.15, 0.2, 0.2, 0.3, 0.5, 0.899, 0.9, 7.0]
    df = spark.createDataFrame([(k, x, "z") for k, x in enumerate(xs)], "event_id int, x double, k string")
    few = scoring.quantile_transform(df, table, "x", "u", output)
    many = scoring.quantile_transform(df, table, "x", "u", output, most=3)
    assert few.columns == many.columns
    a, b = ({r.event_id: r.u for r in f.collect()} for f in (few, many))
    for k in a:
        assert (a[k] is None or math.isnan(a[k])) == (b[k] is None or math.isnan(b[k])) and (a[k] is None or math.isnan(a[k]) or a[k] == pytest.approx(b[k], abs=1e-12)), (k, a[k], b[k])


# --- streams


def test_files_are_folded_in_once(spark, tmp_path):
    src, state = f"{tmp_path}/in", f"{tmp_path}/state"
    rows = spark.range(100).select((F.col("id") % 3).alias("sample"), (F.col("id") % 7).cast("int").alias("n"))
    fold = lambda: fold_multiplicity(spark, src, rows.schema, ["sample"], F.col("n"), state, files=1)
    with pytest.raises(ValueError):
        multiplicity_state(spark, state)
    rows.repartition(3).write.parquet(src)
    assert fold() == 100 and fold() == 0
    once = sorted(map(tuple, multiplicity_state(spark, state).collect()))
    assert once == sorted(map(tuple, rows.groupBy("sample", "n").count().collect()))
    rows.repartition(2).write.mode("append").parquet(src)
    assert fold() == 100
    assert sorted(map(tuple, multiplicity_state(spark, state).collect())) == [(s, n, 2 * c) for s, n, c in once]
    assert len([f for f in os.listdir(f"{state}/counts") if f.startswith("batch=")]) == 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """Its commit is lost after the counts were written: Spark runs the batch again."""
    src, state = f"{tmp_path}/in", f"{tmp_path}/state"
    rows = spark.range(20).select(F.lit("a").alias("sample"), (F.col("id") % 2).cast("int").alias("n"))
    rows.repartition(2).write.parquet(src)
    fold = lambda: fold_multiplicity(spark, src, rows.schema, ["sample"], F.col("n"), state, files=1)
    fold()
    once = sorted(map(tuple, multiplicity_state(spark, state).collect()))
    last = max(os.listdir(f"{state}/checkpoint/commits"), key=lambda f: int(f) if f.isdigit() else -1)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{state}/checkpoint/commits/{f}"):
            os.remove(f"{state}/checkpoint/commits/{f}")
    fold()
    assert sorted(map(tuple, multiplicity_state(spark, state).collect())) == once
