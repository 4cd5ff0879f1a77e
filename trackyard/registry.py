"""All named queries over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackyard.plans import eval_queries, event_queries  # noqa: F401  they register themselves
from trackyard.plans.register import ORACLE_SQL, QUERIES, register  # noqa: F401


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a10_argmax_purity_efficiency"](spark, sf_dir)
