"""The ordering check reads every event unless told otherwise."""

from pyspark.sql import functions as F

from trackyard.operators import stats


def test_ordering_check_reads_every_event(spark):
    pt = F.when(F.col("id") == 200_500, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(2.0), F.lit(1.0)))
    df = spark.range(200_600).select(F.col("id").alias("event_id"), F.struct(pt.alias("pt")).alias("jets"))
    assert tuple(stats.ordering_check(df).first()) == (200_600, 1)
    assert tuple(stats.ordering_check(df, 1000).first()) == (1000, 0)
