"""Plans that every flow rests on: how often rows are shuffled, and what is sent to all tasks."""

import os

import pytest
from pyspark.sql import functions as F

from trackyard.operators import build
from trackyard.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_nesting_shuffles_objects_once(spark):
    """Object rows are ordered, gathered and joined where one shuffle has put them, and are not broadcast however small their files are."""
    found = plan(V.nested(spark, SF))
    assert found.count("Exchange hashpartitioning") == 2 and "Broadcast" not in found and found.count("Scan parquet") == 2


def test_nesting_keeps_odd_rows(spark):
    """Events without objects, without a key or twice stay; objects without an event or a key go; a name that both sides have is no clash."""
    events = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "event_id long, pt string")
    objects = spark.createDataFrame([(1, 1, 5.0), (1, 0, 7.0), (3, 0, 1.0), (None, 0, 2.0), (1, 2, None)], "event_id long, pos int, pt double")
    found = build.nest_objects(events, objects, "jets", ["pt"])
    got = sorted(((r.event_id, r.pt, [j.pt for j in r.jets]) for r in found.collect()), key=repr)
    assert got == sorted([(1, "a", [7.0, 5.0, None]), (1, "a", [7.0, 5.0, None]), (2, "b", []), (None, "c", [])], key=repr)
    assert build.nest_objects(events.limit(0), objects, "jets", ["pt"]).count() == 0
    assert build.nest_objects(events, objects.limit(0), "jets", ["pt"]).agg(F.sum(F.size("jets"))).first()[0] == 0
