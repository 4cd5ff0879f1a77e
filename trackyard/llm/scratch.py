"""Tables that cut a plan in two, in the folder that all executors share: those of the library, and what the operators here ask of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from trackyard.sources.tables import SMALL, drop_since, lookup, mark  # noqa: F401  for the operators
from trackyard.sources.tables import cut as save  # noqa: F401

#: Bytes of the batches in which texts go to Python workers, and the setting of the session that says so.
BATCH_BYTES, BATCH_KEY = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of :data:`BATCH_BYTES`, so that a worker's memory does not depend on how long 10,000 texts are; a session that sets the limit itself keeps its own.

    The setting stays in the session, as plans are run after the operator has returned.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
