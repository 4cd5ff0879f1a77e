"""The flows end to end on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackyard.operators import scoring
from trackyard.plans import flows
from trackyard.sources import tables

FLAT = "event_id long, sample string, dataset string, weight double, J_pt array<double>, J_phi array<double>, M_pt array<double>, M_prov array<int>"


def flat(spark):
    rows = [(k, "QCD" if k % 2 else "TTH", "d", 2.0, [50.0 + j for j in range(k % 5)], [0.1] * (k % 5), [50.0 if j % 2 else -999.0 for j in range(k % 5)], [1] * (k % 5)) for k in range(40)]
    return spark.createDataFrame(rows, FLAT)


def test_events_are_built(spark):
    config = flows.EventConfig.of({"features": {"J": {"pt": "pt", "phi": "phi"}, "M": {"pt": "pt", "prov": "prov"}}, "pads": {"J": {"m": 0.0}}, "matched": {"J": "M"}})
    sums = spark.createDataFrame([("d", 4.0)], "dataset string, value double")
    r = {x["event_id"]: x for x in flows.build_events(flat(spark), config, sums).collect()}
    assert r[0]["J"] == [] and r[3]["weight"] == 0.5
    assert [(j["pt"], j["m"], j["matched"], j["prov"]) for j in r[3]["J"]] == [(50.0, 0.0, False, -1), (51.0, 0.0, True, 1), (52.0, 0.0, False, -1)]


def test_unknown_keys_are_errors():
    with pytest.raises(ValueError):
        flows.TrainingConfig.of({"inputs": {}, "samples": [], "frac_train": 0.8})


def test_training_set_from_files(spark):
    path = tables.workspace(spark)
    events = flat(spark).select("event_id", "weight", F.transform(F.arrays_zip("J_pt", "J_phi"), lambda j: F.struct(j["J_pt"].alias("pt"), j["J_phi"].alias("phi"), F.lit(1).alias("prov"))).alias("jets"), "sample")
    for s in ("QCD", "TTH"):
        events.where(F.col("sample") == s).drop("sample", "event_id").coalesce(1).write.parquet(f"{path}/{s}.parquet")
    config = flows.TrainingConfig.of({
        "inputs": {"Jet": ["pt", "sin_phi", "MASK"], "Event": ["ht"]}, "samples": ["QCD", "TTH"], "particles": ["h"], "labels": {"tth": ["TTH"]}, "encodings": {"signal": {"TTH": 1, "QCD": 2}},
        "classification": ["tth", "signal"], "weights_scale": {"TTH": -1.0, "QCD": 2.0}, "max_frac_events": {"QCD": 0.5}, "njet_min": 1, "njet_max": 4,
    })
    target = tables.workspace(spark)
    counts = {r["split"]: r["rows"] for r in flows.run_training_set(spark, [f"{path}/QCD.parquet", f"{path}/TTH.parquet"], config, target).collect()}
    # 16 of 20 rows of each sample have a jet; QCD is capped at half of its 20 raw rows.
    assert counts == {"train": 8 + 12, "test": 2 + 4}
    row = spark.read.parquet(f"{target}/rows").where("sample = 'QCD'").first()
    assert row["classifications"]["event"].asDict() == {"tth": 0, "signal": 2} and row["weights"]["weight"] == 4.0 and len(row["inputs"]["Jet"]["pt"]) == 4


def test_report_of_scores(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(k, int(k % 9 + 1), 1.0, [float(x) for x in rng.random(3)]) for k in range(200)], "event_id long, signal int, weight double, v array<double>")
    report = flows.score_and_report(rows, scoring.linear_softmax(rng.random((3, 10)), rng.random(10)), "v")
    assert sum(r["value"] for r in report["confusion"].collect()) == pytest.approx(sum(r["recall"] for r in report["classes"].collect()) + sum(r["value"] for r in report["confusion"].where("`true` <> pred").collect()))
    assert {r["region"] for r in report["regions"].collect()} >= {"inclusive"} and report["scored"].count() == 200
    assert all(0 <= r["fpr"] <= 1 for r in report["roc"].collect())


def test_report_by_slices(spark, tmp_path):
    """A model of several inputs, scored by slices: the same report as without."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame(
        [(k, int(k % 9 + 1), 1.0, [[float(x) for x in rng.random(2)] for _ in range(3)], [bool(x > 0.3) for x in rng.random(3)], [float(rng.random())]) for k in range(60)],
        "event_id long, signal int, weight double, jets array<array<double>>, mask array<boolean>, event array<double>",
    )
    net = scoring.masked_linear(rng.random((2, 10)), rng.random((1, 10)), rng.random(10), "jets", "mask", "event")
    feed = {x: x for x in ("jets", "mask", "event")}
    one, two = flows.score_and_report(rows, net, feed), flows.score_and_report(rows, net, feed, slices=(f"{tmp_path}/s", 4))
    for name in ("confusion", "purity"):
        assert sorted(map(str, one[name].collect())) == sorted(map(str, two[name].collect()))
    assert two["scored"].count() == 60
