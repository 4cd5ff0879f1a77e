"""Running sums over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackyard.sources.tables import cut


def running_sums(df: DataFrame, by: list, sums: dict[str, str], groups: list[str] | None = None, part: str | None = None) -> DataFrame:
    """``df`` with ``sums`` (new name to summed column) run over rows in order of ``by``, within ``groups`` if given.

    Rows are range-partitioned by group and order, written once so that bounds stay as they are, summed within each file's window, and lifted by the sum
    of the parts before: one row for each part and group. ``by`` should not repeat within a group, else ties are in any order. ``part`` names a column for the number of
    a row's part: parts follow each other in order.
    """
    groups = groups or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *groups, *by).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy("__part", *groups).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("__part", *groups).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = totals.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in groups], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    match = F.col("__part") == F.col("__p")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    out = ranged.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}).join(lifts, match)
    return out.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).select(*df.columns, *sums, *([F.col("__part").alias(part)] if part else []))


def running_last(df: DataFrame, by: list[str], value: str, out: str, groups: list[str]) -> DataFrame:
    """``df`` with ``out``: the last ``value`` that is not null at or before each row in order of ``by`` within ``groups``.

    Parts as in :func:`running_sums`: rows look back within their part, and the last value of the parts before is carried in by one row for each part and group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *groups, *by).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy("__part", *groups).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy("__part", *groups).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*by))).alias("__end"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = ends.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in groups], F.last("__end", ignorenulls=True).over(before).alias("__before"))
    match = F.col("__part") == F.col("__p")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    out_rows = ranged.withColumn("__last", F.last(value, ignorenulls=True).over(inner)).join(lifts, match)
    return out_rows.withColumn(out, F.coalesce("__last", "__before")).select(*dict.fromkeys([*df.columns, out]))
