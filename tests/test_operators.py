"""Edge cases on small hand-made tables, and properties."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackyard.functions import columns as C
from trackyard.operators import build, evaluate, joins, order, scoring, select, stats, tensors
from trackyard.sources import io, tables

JET = "array<struct<pt:double,eta:double,phi:double,btag_M:int,prov:int>>"


def events(spark, rows):
    return spark.createDataFrame([(k, [(float(p), 0.1, 0.2, b, q) for p, b, q in jets]) for k, jets in rows], f"event_id long, jets {JET}")


def test_targets_empty_one_and_seventeen_jets(spark):
    df = events(spark, [(0, []), (1, [(50, 1, 1)]), (2, [(99 - k, 0, 1 if k in (3, 16) else 5 if k in (0, 1) else 0) for k in range(17)])])
    t = {r["event_id"]: r["targets"] for r in tensors.assign_targets(df, 16).collect()}
    assert (t[0].h.b1, t[0].t2.b) == (-1, -1)
    assert (t[1].h.b1, t[1].h.b2) == (0, -1)
    assert (t[2].h.b1, t[2].h.b2) == (3, -1)  # the second one is beyond the cap
    assert (t[2].t1.q1, t[2].t1.q2) == (0, 1)


def test_pad_mask_and_ht(spark):
    df = events(spark, [(0, []), (1, [(5, 0, 0)] * 3)]).select("event_id", C.pad_clip(F.col("jets.pt"), 2, 0.0).alias("pt"), C.total(F.col("jets.pt")).alias("ht"))
    r = {x["event_id"]: x for x in df.withColumn("m", C.mask_from_pt(F.col("pt"))).collect()}
    assert r[0]["pt"] == [0.0, 0.0] and r[0]["m"] == [False, False] and r[0]["ht"] == 0
    assert r[1]["pt"] == [5.0, 5.0] and r[1]["m"] == [True, True] and r[1]["ht"] == 15


def test_nan_pt_counts_as_an_object(spark):
    df = spark.createDataFrame([([float("nan"), 0.0],)], "pt array<double>")
    assert df.select(C.mask_from_pt(F.col("pt")).alias("m")).first()["m"] == [True, False]


def test_argmax_ties_and_nan(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.5, 0.5],), ([0.1, float("nan"), 0.9],)], "s array<double>")
    assert [r[0] for r in df.select(C.argmax(F.col("s"))).collect()] == [1, 0, 1]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (-0.1,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(C.histogram_bin(F.col("x"), 0.0, 1.0, 50)).collect()] == [0, 49, None, None, None, None]
    assert [r[0] for r in df.select(C.edge_bin(F.col("x"), [0.0, 0.5, 1.0])).collect()] == [0, 1, None, None, None, None]


def test_nan_scores_fail_all_cuts(spark):
    df = spark.createDataFrame([(1, float("nan"), 0.1, 0.9), (2, 0.0001, 0.1, 0.9), (3, 0.0001, 0.5, 0.1)], "event_id int, qcd double, ttlf double, tthbb double")
    found = {(r["event_id"], r["region"]) for r in select.cut_regions(df).collect()}
    assert found == {(1, "inclusive"), (2, "inclusive"), (2, "QCD veto"), (2, "SR ttHbb"), (3, "inclusive"), (3, "QCD veto"), (3, "CR ttlf")}


def test_slices_exclude_both_ends(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.7,)], "s double")
    assert [(r["s"], r["slice"]) for r in select.score_slices(df, [0.0, 0.5, 1.0], "s").collect()] == [(0.7, 1)]


def test_fully_matched_channels(spark):
    codes = [1, 1, 5, 5, 2, 6, 6, 3]
    df = events(spark, [(0, [(9 - k, 0, c) for k, c in enumerate(codes)]), (1, [(9 - k, 0, c) for k, c in enumerate([1, 1, 5, 5, 2, 3])])])
    assert [r["event_id"] for r in select.fully_matched(df).collect()] == [0]
    assert {r["event_id"] for r in select.fully_matched(df, channel="lepton").collect()} == {0, 1}


def test_path_must_name_one_sample(spark):
    df = spark.createDataFrame([("/QCD/a",), ], "path string")
    assert build.source_sample(df, ["QCD", "TTH"]).first()["sample"] == "QCD"
    for path in ("/none/a", "/QCD/TTH/a"):
        with pytest.raises(PySparkException):
            build.source_sample(spark.createDataFrame([(path,)], "path string"), ["QCD", "TTH"]).collect()


def test_unknown_samples_are_errors(spark):
    df = spark.createDataFrame([("X", 1.0)], "sample string, weight double")
    with pytest.raises(PySparkException):
        build.scale_weights(df, {"QCD": 1.0}).collect()
    with pytest.raises(PySparkException):
        build.encode_class(df, {"signal": {"QCD": 1}}).collect()
    with pytest.raises(ValueError):
        build.encode_class(df, {"signal": 3})


def test_attach_matching(spark):
    df = events(spark, [(0, [(50, 0, 0), (40, 0, 0)])]).withColumn("matched", F.array(F.struct(F.lit(-999.0).alias("pt"), F.lit(1).alias("prov")), F.struct(F.lit(40.0).alias("pt"), F.lit(5).alias("prov"))))
    assert [(j["matched"], j["prov"]) for j in build.attach_matching(df).first()["jets"]] == [(False, -1), (True, 5)]
    with pytest.warns(UserWarning):
        build.attach_matching(df.drop("matched"))


def test_zip_needs_equal_lengths(spark):
    df = spark.createDataFrame([([1.0], [1, 2])], "J_pt array<double>, J_q array<int>")
    with pytest.raises(PySparkException):
        build.zip_collection(df, "J", ["pt", "q"]).collect()
    assert build.zip_collection(spark.createDataFrame([([1.0], [2])], df.schema), "J", ["pt", "q"]).first()["J"][0].asDict() == {"pt": 1.0, "q": 2}


def test_singleton_needs_one(spark):
    with pytest.raises(PySparkException):
        build.to_singleton(events(spark, [(0, [])]), "jets").collect()


def test_unflatten_keeps_places(spark):
    values = spark.createDataFrame([(k, k * 10) for k in range(5)], "at long, value long")
    counts = spark.createDataFrame([(7, 0, 2), (8, 2, 0), (9, 2, 3)], "event_id long, first long, n int")
    assert sorted(map(tuple, build.unflatten(values, counts).collect())) == [(7, 0, 0), (7, 1, 10), (9, 0, 20), (9, 1, 30), (9, 2, 40)]


def test_features_need_mask_and_collection(spark):
    df = events(spark, [(0, [])])
    with pytest.raises(ValueError):
        tensors.object_features(df, {"Jet": ["pt"]})
    with pytest.raises(ValueError):
        tensors.object_features(df, {"Lepton": ["pt"]})
    with pytest.raises(ValueError):
        tensors.classification_columns(df, ["signal"])


def test_split_is_a_partition(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(1003)], "event_id long, source string")
    r = order.train_test_split(df, "source").groupBy("source", "split").agg(F.count("*").alias("n"), F.max("event_id").alias("hi"), F.min("event_id").alias("lo")).collect()
    n = {(x["source"], x["split"]): x for x in r}
    assert n["a", "train"]["n"] == int(0.8 * 668) and n["a", "train"]["n"] + n["a", "test"]["n"] == 668
    assert n["a", "train"]["hi"] < n["a", "test"]["lo"] and n["b", "train"]["n"] == int(0.8 * 335)
    up = order.train_test_split(df, "source", round_up=True).where("split = 'train' AND source = 'a'").count()
    assert up == math.ceil(0.8 * 668)


def test_cap_counts_raw_rows(spark):
    df = spark.createDataFrame([(k, "q") for k in range(100)], "event_id long, source string")
    kept = df.where("event_id >= 90")
    assert order.cap_fraction(df, kept, {"q": 0.05}, "source").count() == 5


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").alias("event_id"))
    a = [r[0] for r in order.shuffle(df, 1).collect()]
    assert sorted(a) == list(range(500)) and a != list(range(500)) and a == [r[0] for r in order.shuffle(df.repartition(7), 1).collect()]


def test_slices_with_fewer_rows_than_jobs(spark):
    df = spark.range(3).select(F.col("id").alias("event_id"))
    assert sorted(r["slice"] for r in order.contiguous_slices(df, 10).collect()) == [0, 1, 2]


def test_step_before_the_first_epoch(spark):
    m = spark.createDataFrame([(1, 0, 0.5), (1, 5, 0.6), (1, 7, 0.7), (1, 9, 0.8)], "version int, step int, value double")
    e = spark.createDataFrame([(1, 5, 0), (1, 8, 1)], "version int, step int, epoch int")
    assert {r["step"]: r["epoch"] for r in joins.steps_to_epochs(m, e).collect()} == {0: 0, 5: 0, 7: 0, 9: 1}


def test_resolve_sample_matches_a_cross_join(spark):
    rng = np.random.default_rng(0)
    a, b = [int(x) for x in rng.integers(0, 3000, 80)] + [9_999_950], [int(x) for x in rng.integers(0, 3000, 80)] + [10_000_000, 0]
    got = joins.resolve_sample(spark.createDataFrame(list(enumerate(a)), "dataset long, n_events long"), spark.createDataFrame(list(enumerate(b)), "sample long, n long"))
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 5 + 1e-5 * abs(y)}
    rows = [(r["dataset"], r["sample"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_zero_denominators(spark):
    counts = spark.createDataFrame([(1, 0, 2.0), (2, 2, -1.0)], "true int, pred int, w double")
    r = {x["class"]: x for x in evaluate.argmax_purity_efficiency(counts).collect()}
    assert r[1]["purity"] == 0 and r[1]["efficiency"] == 0 and r[2]["purity"] == 0
    m = {(x["true"], x["pred"]): x["value"] for x in evaluate.confusion_matrix(counts, "true").collect()}
    assert len(m) == 81 and m[5, 5] == 0 and m[2, 2] == 1


def test_roc_and_auc_match_numpy(spark):
    rng = np.random.default_rng(1)
    s, t, w = np.round(rng.random(400), 2), rng.random(400) < 0.4, rng.random(400)
    df = spark.createDataFrame([(float(a), bool(b), float(c)) for a, b, c in zip(s, t, w, strict=True)], "score double, is_true boolean, weight double")
    area = sum(w[i] * w[j] * (1 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0) for i in np.flatnonzero(t) for j in np.flatnonzero(~t)) / (w[t].sum() * w[~t].sum())
    assert evaluate.auc(evaluate.roc_points(df)).first()["auc"] == pytest.approx(area, abs=1e-9)


def test_weighted_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    x, w = rng.random(300), rng.random(300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w, strict=True)], "x double, w double")
    got = [r["quantile"] for r in evaluate.weighted_quantiles(df, "x", "w", 41).orderBy("k").collect()]
    o = np.argsort(x)
    assert np.allclose(got, np.interp(np.linspace(0, 1, 41), np.cumsum(w[o]) / w.sum(), x[o]))
    with pytest.raises(PySparkException):
        evaluate.weighted_quantiles(df.withColumn("w", F.lit(-1.0)), "x", "w", 3).collect()


def test_quantile_transform_is_monotone_and_held(spark):
    table = spark.createDataFrame([(0, 0.1, 0.0), (1, 0.4, 0.5), (2, 0.9, 1.0)], "k int, quantile double, reference double")
    df = spark.createDataFrame([(0.0,), (0.1,), (0.25,), (0.9,), (1.0,)], "x double")
    assert [r["u"] for r in scoring.quantile_transform(df, table, "x", "u").collect()] == pytest.approx([0.0, 0.0, 0.25, 1.0, 1.0])
    assert [r["u"] for r in scoring.quantile_transform(df, table, "x", "u", "normal").collect()][0] == -math.inf


def test_cumulative_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.0, 1, 1.0), (1.0, 1, 1.0), (1.0, 0, 1.0), (0.5, 0, 3.0)], "s double, t int, weight double")
    r = [x["value"] for x in evaluate.cumulative_significance(df, "s", F.col("t") == 1, 3).orderBy("k").collect()]
    assert r == pytest.approx([1 / 2, 1.0, 0.0])


def test_significance_bins_are_open_above(spark):
    df = spark.createDataFrame([(1.0, 1, 1.0), (0.0, 1, 2.0), (0.0, 0, 4.0)], "s double, t int, weight double")
    assert [(r["bin"], r["value"]) for r in evaluate.binned_significance(df, "s", F.col("t") == 1).collect()] == [(0, 1.0)]


def test_discrete_percentile_rules(spark):
    hist = spark.createDataFrame([(3, 1), (4, 1), (50, 2)], "n int, events long")
    r = stats.discrete_percentiles(hist, [], 40, {"a": 0.0, "b": 0.2, "c": 0.9, "d": 1.0}).first()
    assert tuple(r) == (3.0, 3.0, 50.0, 50.0)


def test_ordering_small_events(spark):
    df = events(spark, [(0, []), (1, [(5, 0, 0)]), (2, [(5, 0, 0), (6, 0, 0)]), (3, [(6, 0, 0), (6, 0, 0)])])
    assert tuple(stats.ordering_check(df).first()) == (4, 1)


def test_weight_invariant_raises(spark):
    df = spark.createDataFrame([(True, 1.0, 2.0)], "is_data boolean, weight double, weight_original double")
    assert stats.weight_invariant(df).first()["changed"] == 1
    with pytest.raises(PySparkException):
        stats.require_weight_invariant(df).collect()


def test_shards_must_agree(spark):
    a = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    with pytest.raises(ValueError):
        io.merge_shards([a, a.withColumn("y", F.lit(1))])
    with pytest.raises(ValueError):
        io.merge_shards([a, a.select(F.lit(1).alias("x"))])
    with pytest.raises(PySparkException):
        io.merge_shards([a, spark.createDataFrame([([1.0],)], a.schema)], fixed=["x"]).collect()


def test_outputs_are_not_overwritten(spark):
    path = tables.workspace(spark)
    df = spark.range(3).select("id", F.lit("a").alias("sample"))
    io.write_events(df, path)
    with pytest.raises(PySparkException):
        io.write_events(df, path)
    with pytest.raises(ValueError):
        io.read_events(spark, ["/x.csv"])


def test_no_single_partition_on_events(spark):
    df = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("source"))
    plan = order.train_test_split(df, "source")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_jets_scan_reads_only_pt(spark):
    path = tables.workspace(spark)
    events(spark, [(0, [(5, 0, 0)])]).write.parquet(path)
    plan = tensors.event_ht(spark.read.parquet(path)).select("event_id", "ht")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,jets:array<struct<pt:double>>>" in plan
