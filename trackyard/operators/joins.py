"""Joins by key, by range and by time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.operators.prefix import running_last
from trackyard.sources.tables import lookup

#: Rows of one side of a cell that meet those of the other at once, and pairs that a task looks at; both about.
BLOCK, PAIRS = 2_000, 32_000_000


def join_predictions(truth: DataFrame, predicted: DataFrame, key: str = "event_id") -> DataFrame:
    """Assignments of the truth beside the predicted ones, by key."""
    return truth.join(predicted, key)


def attach_scores(events: DataFrame, scores: DataFrame, key: str = "event_id", complete: bool = False) -> DataFrame:
    """Events with their scores; ``has_score`` is false where no slice holds the event.

    A key that has scores twice is an error, which ends the job that reads it: it would make two events of one. With ``complete`` an event without scores is an error too, and so are scores without an event.
    Scores are counted by key where they lie and joined in the same partitioning, so the check adds no shuffle; repeated rows are one row a task before they meet.
    """
    values = [c for c in scores.columns if c != key]
    own = scores.groupBy(key).agg(F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in values])
    rows = events.withColumn("__event", F.lit(True)).join(own, key, "full" if complete else "left")
    name = F.concat(F.lit("event "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    fault = F.when(F.col("__n") > 1, F.concat(name, F.lit(" has scores "), F.col("__n").cast("string"), F.lit(" times")))
    if complete:
        fault = fault.when(F.col("__n").isNull(), F.concat(name, F.lit(" has no scores"))).when(F.col("__event").isNull(), F.concat(F.lit("there are scores of no "), name))
    checked = rows.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))
    return checked.withColumn("has_score", F.col("__n").isNotNull()).select(*events.columns, *values, "has_score")


def missing_scores(events: DataFrame, scores: DataFrame, key: str = "event_id") -> DataFrame:
    """Events that no slice holds."""
    return events.join(scores.select(key), key, "left_anti")


def dataset_dimension(df: DataFrame, dimension: DataFrame, key: str = "sample") -> DataFrame:
    """Values of a table with one row per sample. Spark broadcasts it while it is small."""
    return df.join(dimension, key, "left")


def _tolerance_level(n: Column, absolute: float, relative: float) -> Column:
    """Tolerances of a level are from 2^level to its double."""
    return F.floor(F.log2(absolute + relative * F.abs(n)))


def resolve_sample(counts: DataFrame, cutflow: DataFrame, absolute: float = 5, relative: float = 1e-5) -> DataFrame:
    """(dataset, sample) where a cut-flow count is as good as the dataset's: |a - b| <= absolute + relative * |b|.

    Counts are cut into cells as wide as the largest tolerance of their size; each cut-flow row looks into its own cell and the two beside it, so this
    is an equi-join, whatever the number of rows. All pairs are asked for, so rows of a cell are the square of its rows: each side of a cell is dealt by hash to blocks of some
    :data:`BLOCK` rows, a pair of blocks is one key, and the tasks are as many as the pairs to be looked at fill, however few bytes they are made from.
    """
    width = lambda lv: F.pow(F.lit(2.0), lv + 1)
    right = cutflow.select("sample", "n", _tolerance_level(F.col("n"), absolute, relative).alias("__level"))
    levels = right.select("__level").distinct()
    left = counts.select("dataset", "n_events").join(F.broadcast(levels)).withColumn("__cell", F.floor(F.col("n_events") / width(F.col("__level"))))
    right = right.withColumn("__cell", F.explode(F.array(*[F.floor(F.col("n") / width(F.col("__level"))) + d for d in (-1, 0, 1)])))
    cell = ["__level", "__cell"]
    sizes = left.groupBy(*cell).agg(F.count("*").alias("__l")).join(right.groupBy(*cell).agg(F.count("*").alias("__r")), cell)
    tiles = lookup(sizes, "tiles")
    tasks = 1 + int(tiles.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0) // PAIRS
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    key = [*cell, "__a", "__b"]
    left = left.join(tiles, cell).select("dataset", "n_events", *cell, F.pmod(F.xxhash64("dataset"), blocks("__l")).alias("__a"), each("__r").alias("__b"))
    right = right.join(tiles, cell).select("sample", "n", *cell, each("__l").alias("__a"), F.pmod(F.xxhash64("sample"), blocks("__r")).alias("__b"))
    close = F.abs(F.col("n_events") - F.col("n")) <= absolute + relative * F.abs(F.col("n"))
    # A number of partitions that is named is not packed by bytes.
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).where(close).select("dataset", "sample", "n_events", "n")


def without_sample(counts: DataFrame, cutflow: DataFrame, absolute: float = 5, relative: float = 1e-5) -> DataFrame:
    """Rows of ``counts`` that no cut-flow count fits, by the rule of :func:`resolve_sample`, without its pairs.

    Cells are as wide as the least tolerance of their size, so a count reaches two cells either way. Of a cell only the least and the largest cut-flow count are kept: the fit of one further off is no better,
    as a tolerance grows by less than the distance. Each distinct count meets five rows of a level.
    """
    if not 0 <= relative < 1:
        raise ValueError("a relative tolerance of 1 or more fits anything")
    width = lambda lv: F.pow(F.lit(2.0), lv)
    flow = cutflow.select("n", _tolerance_level(F.col("n"), absolute, relative).alias("__level"))
    ends = flow.groupBy("__level", F.floor(F.col("n") / width(F.col("__level"))).alias("__cell")).agg(F.min("n").alias("__low"), F.max("n").alias("__high"))
    values = counts.select("n_events").distinct().join(F.broadcast(flow.select("__level").distinct()))
    values = values.withColumn("__cell", F.explode(F.array(*[F.floor(F.col("n_events") / width(F.col("__level"))) + d for d in range(-2, 3)])))
    close = lambda n: F.abs(F.col("n_events") - F.col(n)) <= absolute + relative * F.abs(F.col(n))
    fitting = lookup(values.join(ends, ["__level", "__cell"]).where(close("__low") | close("__high")).select("n_events").distinct(), "fitting")
    return counts.join(fitting, "n_events", "left_anti").select(*counts.columns)


def unresolved(counts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Datasets that no cut-flow row fits."""
    return counts.join(resolved.select("dataset"), "dataset", "left_anti")


def require_resolved(counts: DataFrame, resolved: DataFrame) -> DataFrame:
    """``resolved``, where a dataset that no cut-flow row fits is an error."""
    rows = counts.select("dataset").join(resolved, "dataset", "left")
    lost = F.raise_error(F.concat(F.lit("no sample has as many events as "), F.col("dataset").cast("string"))).cast(resolved.schema["sample"].dataType)
    return rows.withColumn("sample", F.coalesce("sample", lost))


def steps_to_epochs(metrics: DataFrame, epochs: DataFrame, run: str = "version") -> DataFrame:
    """As-of join: each metric row with the last epoch marked at or before its step; the first epoch before any mark.

    Marks sort before metrics at equal steps. Rows are range-partitioned by run and step, and look back over parts (:func:`running_last`), so a long run is many tasks.
    """
    names = [c for c in metrics.columns if c not in (run, "step")]
    blank = {c: F.lit(None).cast(metrics.schema[c].dataType) for c in names}
    marks = epochs.select(run, "step", *[blank[c].alias(c) for c in names], "epoch", F.lit(0).alias("__kind"))
    rows = metrics.select(run, "step", *names, F.lit(None).cast(epochs.schema["epoch"].dataType).alias("epoch"), F.lit(1).alias("__kind"))
    first = epochs.groupBy(F.col(run).alias("__run")).agg(F.min_by("epoch", "step").alias("__first"))
    found = running_last(marks.union(rows), ["step", "__kind"], "epoch", "epoch", [run]).where("__kind = 1")
    joined = found.join(first, F.col(run).eqNullSafe(F.col("__run")), "left")
    return joined.withColumn("epoch", F.coalesce("epoch", "__first")).drop("__kind", "__run", "__first")


def apply_reweighting(df: DataFrame, ratios: DataFrame, masks: Mapping[str, str], njet: str = "njet") -> DataFrame:
    """``weight_<mask>`` for each named mask (name to boolean column): the ratio of the event's jet count, 7 and more as one; 1 outside the mask or below 4 jets.

    ``ratios`` (mask, njet, ratio) has four rows a mask.
    """
    for name, column in masks.items():
        own = ratios.where(F.col("mask") == name).select(F.col("njet").alias("__n"), F.col("ratio").alias("__ratio"))
        # Four rows: jet counts 4, 5, 6 and 7.
        df = df.join(F.broadcast(own), F.least(F.col(njet), F.lit(7)) == F.col("__n"), "left")
        df = df.withColumn(f"weight_{name}", F.when(F.col(column), F.coalesce("__ratio", F.lit(1.0))).otherwise(F.lit(1.0))).drop("__n", "__ratio")
    return df
