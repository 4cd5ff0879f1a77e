"""Batched scoring of stacked inputs, and quantile transforms of scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackyard.operators.prefix import running_last
from trackyard.sources.tables import cut, lookup

#: Rows of a fitted quantile table that are sent to tasks.
QUANTILES = 1_000_000


def score_events(df: DataFrame, factory: Callable[[], Callable[[np.ndarray], np.ndarray]], vector: str, key: str = "event_id", batch: int = 2048) -> DataFrame:
    """(key, scores) of all rows: ``factory`` makes a scorer once a task, which gets batches (rows, features) and gives (rows, classes).

    ``vector`` is an array of doubles, of one length. The last batch of a task may be smaller.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for part in parts:
            for k in range(0, len(part), batch):
                own = part.iloc[k : k + batch]
                scores = scorer(np.stack(own[vector].to_numpy()))
                yield pd.DataFrame({key: own[key].to_numpy(), "scores": list(np.asarray(scores, np.float64))})

    return df.select(key, vector).mapInPandas(run, f"{key} {kind}, scores array<double>")


def tensor(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally nested lists as one array with a dimension for each level; numbers share Arrow's memory. Rows of unequal shapes, and nulls, are errors."""
    shape = [len(column)]
    while pa.types.is_list(column.type):
        sizes = np.diff(column.offsets.to_numpy())
        if column.null_count or (len(sizes) and (sizes != sizes[0]).any()):
            raise ValueError("an input has rows of different shapes: pad it to one length")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        column = column.flatten()
    if column.null_count:
        raise ValueError("an input has nulls: fill them")
    return column.to_numpy(zero_copy_only=False).reshape(shape)


Feed = dict[str, np.ndarray]


def score_inputs(df: DataFrame, factory: Callable[[], Callable[[Feed], np.ndarray]], inputs: Mapping[str, str], key: str = "event_id", batch: int = 2048, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, scores) of all rows by a model of several inputs: names of inputs to columns.

    A column may be a number, a vector, or vectors of each object of an event (arrays of arrays, padded to one length), and a mask is an array of booleans; each becomes one array whose first dimension
    is the row, made of Arrow's own buffers. ``factory`` makes a scorer once a task; it gets batches of at most ``batch`` rows as a dictionary of arrays, and gives (rows, classes). The last batch of a task
    may be smaller, and no row is left out. Rows of other shapes within a batch, and nulls, are errors.
    """
    keys = [key, *keep]
    fields = [*[df.schema[c] for c in keys], T.StructField("scores", T.ArrayType(T.DoubleType()))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        for part in parts:
            for k in range(0, len(part), batch):
                own = part.slice(k, batch)
                feed = {name: tensor(own[f"__in_{name}"]) for name in inputs}
                scores = np.ascontiguousarray(scorer(feed), np.float64)
                if scores.ndim != 2 or len(scores) != len(own):
                    raise ValueError(f"the scorer gave an array of shape {scores.shape} for {len(own)} rows")
                ends = np.arange(len(own) + 1, dtype=np.int32) * scores.shape[1]
                yield pa.RecordBatch.from_arrays([*[own[c] for c in keys], pa.ListArray.from_arrays(pa.array(ends), pa.array(scores.ravel()))], [*keys, "scores"])

    return df.select(*keys, *[F.col(c).alias(f"__in_{name}") for name, c in inputs.items()]).mapInArrow(run, T.StructType(fields))


# --- slices -----------------------------------------------------------------------------------------------------

CHECKS = "slice int, first string, n_rows long, checksum long"


def _checks(df: DataFrame, key: str) -> DataFrame:
    """Of each slice its rows and a checksum of its keys, in which a key counts as often as it is there."""
    return df.groupBy("slice").agg(F.count("*").alias("n_rows"), F.sum(F.shiftright(F.xxhash64(key), 20)).alias("checksum"))


def plan_slices(df: DataFrame, path: str, n_jobs: int, key: str = "event_id") -> DataFrame:
    """The manifest of a sliced scoring under ``path``: (slice, first key as text, n_rows, checksum of the keys), made once and read from then on.

    Slices are contiguous in order of key. A manifest that is there already must fit ``df``, else it is an error: scores of other events would be mixed.
    """
    from trackyard.operators.order import contiguous_slices

    spark, where = df.sparkSession, f"{path}/manifest"
    if not _exists(spark, f"{where}/_SUCCESS"):
        sliced = contiguous_slices(df.select(key), n_jobs, key)
        firsts = sliced.groupBy(F.col("slice").alias("s")).agg(F.min(key).cast("string").alias("first"))
        made = _checks(sliced, key).join(firsts, F.col("slice") == F.col("s")).select("slice", "first", "n_rows", "checksum")
        made.coalesce(1).write.mode("overwrite").parquet(where)
    return spark.read.schema(CHECKS).parquet(where)


def sliced(df: DataFrame, manifest: DataFrame, key: str = "event_id") -> DataFrame:
    """``df`` with its slice by the first keys of the manifest, one a slice."""
    kind = df.schema[key].dataType
    firsts = [r["first"] for r in manifest.orderBy("slice").collect()]
    return df.withColumn("slice", sum(((F.col(key) >= F.lit(x).cast(kind)).cast("int") for x in firsts[1:]), F.lit(0)))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def score_slices(df: DataFrame, factory: Callable, inputs: Mapping[str, str], path: str, n_jobs: int, key: str = "event_id", batch: int = 2048, most: int | None = None) -> list[int]:
    """Score ``df`` slice by slice under ``path`` and return the slices that this call has scored, at most ``most`` of them.

    A slice is one Spark job over its range of keys, and counts as finished when its folder has been committed (``_SUCCESS``): a run that was ended at any time is taken up by calling this again,
    which skips what is finished and scores an unfinished slice anew, in place of what was left of it. :func:`merged_slices` reads them.
    """
    spark, manifest = df.sparkSession, plan_slices(df, path, n_jobs, key)
    found = _checks(sliced(df.select(key), manifest, key), key).select("slice", F.col("n_rows").alias("n"), F.col("checksum").alias("c"))
    if other := [r["slice"] for r in manifest.join(found, "slice", "full").where("NOT (n_rows <=> n AND checksum <=> c)").collect()]:
        raise ValueError(f"the manifest in {path} is of other events: slices {sorted(other)}")
    rows, kind = manifest.orderBy("slice").collect(), df.schema[key].dataType
    scored = []
    for r, after in zip(rows, [*rows[1:], None], strict=True):
        target = f"{path}/scores/slice={r['slice']}"
        if most is not None and len(scored) >= most:
            break
        if _exists(spark, f"{target}/_SUCCESS"):
            continue
        own = df.where(F.col(key) >= F.lit(r["first"]).cast(kind))
        own = own if after is None else own.where(F.col(key) < F.lit(after["first"]).cast(kind))
        score_inputs(own, factory, inputs, key, batch).write.mode("overwrite").parquet(target)
        scored.append(r["slice"])
    return scored


def merged_slices(spark, path: str, key: str = "event_id") -> DataFrame:
    """(key, scores, slice) of all slices under ``path``; a slice that is missing, unfinished, doubled or has other keys than the manifest says is an error that names it.

    Counts and checksums are one grouped pass over the keys; the driver sees a row a slice.
    """
    manifest = spark.read.schema(CHECKS).parquet(f"{path}/manifest")
    if open_ := [r["slice"] for r in manifest.orderBy("slice").collect() if not _exists(spark, f"{path}/scores/slice={r['slice']}/_SUCCESS")]:
        raise ValueError(f"missing slices in {path}: {open_}")
    scores = spark.read.parquet(f"{path}/scores").select(key, "scores", F.col("slice").cast("int").alias("slice"))
    found = _checks(scores, key).select("slice", F.col("n_rows").alias("n"), F.col("checksum").alias("c"))
    both = manifest.join(found, "slice", "full").where("NOT (n_rows <=> n AND checksum <=> c)").orderBy("slice").collect()
    if both:
        raise ValueError(f"slices in {path} differ from the manifest: " + ", ".join(f"{r['slice']} has {r['n'] or 0} of {r['n_rows'] or 0} rows" for r in both))
    return scores


# --- scorers ----------------------------------------------------------------------------------------------------


def masked_linear(weights: np.ndarray, event_weights: np.ndarray, bias: np.ndarray, objects: str, mask: str, event: str) -> Callable[[], Callable[[Feed], np.ndarray]]:
    """Factory of a classifier over objects and event features: the mean of the objects that the mask holds (0 for none), then a linear map of both and a softmax."""

    def factory():
        def scorer(feed: Feed) -> np.ndarray:
            there = feed[mask].astype(np.float64)
            mean = np.einsum("njf,nj->nf", feed[objects], there) / np.maximum(1, there.sum(axis=1))[:, None]
            z = mean @ weights + feed[event] @ event_weights + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return scorer

    return factory


def linear_softmax(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Factory of a linear classifier with a softmax."""

    def factory():
        def scorer(x: np.ndarray) -> np.ndarray:
            z = x @ weights + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return scorer

    return factory


def softmax(logits: Column) -> Column:
    """Softmax of an array of doubles, in Spark's own functions."""
    e = F.transform(logits, lambda z: F.exp(z))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def _normal(p: float) -> float:
    return -np.inf if p <= 0 else np.inf if p >= 1 else NormalDist().inv_cdf(p)


def quantile_transform(df: DataFrame, table: DataFrame, x: str, out: str, output: str = "uniform", most: int = QUANTILES) -> DataFrame:
    """``x`` through fitted quantiles (k, quantile, reference): linear between them, held at both ends; null and NaN stay.

    ``output`` 'normal' gives standard normal values, infinite at the ends. A table of at most ``most`` rows is sent to all tasks. Beyond that it meets the rows in a range-partitioned merge (:func:`merge_quantiles`), with the same
    results.
    """
    if output not in ("uniform", "normal"):
        raise ValueError(f"no output distribution {output}")
    rows = table.orderBy("k").limit(most + 1).select("quantile", "reference").collect()
    if len(rows) > most:
        return merge_quantiles(df, table, x, out, output)
    grid, target = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    if output == "normal":
        target = np.array([_normal(p) for p in target])
    sent = df.sparkSession.sparkContext.broadcast((grid, target))

    def through(values: pd.Series) -> pd.Series:
        return pd.Series(np.interp(values.to_numpy(float), *sent.value))

    return df.withColumn(out, F.pandas_udf(through, "double")(F.col(x)))


def merge_quantiles(df: DataFrame, table: DataFrame, x: str, out: str, output: str = "uniform") -> DataFrame:
    """:func:`quantile_transform` for a table of any size: each row meets the last quantile at or below its ``x``, which carries the one after it.

    Distinct values of ``x`` and the quantiles are range-partitioned by value together (:func:`running_last`), so neither the table nor a hot value is in one task; the values then go back to the rows by a join.
    """
    knots = table.select("k", F.col("quantile").cast("double").alias("q"), F.col("reference").cast("double").alias("r"))
    if output == "normal":
        knots = knots.withColumn("r", F.pandas_udf(lambda p: p.map(_normal).astype(float), "double")(F.col("r")))
    after = knots.select((F.col("k") - 1).alias("k"), F.col("q").alias("q2"), F.col("r").alias("r2"))
    knots = cut(knots.join(after, "k", "left").select("k", F.struct("q", "r", "q2", "r2").alias("knot")))
    value, kind = F.col(x).cast("double"), knots.schema["knot"].dataType
    values = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).distinct()
    marks = knots.select(F.col("knot.q").alias("v"), F.lit(0).alias("kind"), F.col("k").cast("long").alias("k"), "knot")
    both = marks.unionByName(values.select("v", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("k"), F.lit(None).cast(kind).alias("knot")))
    found = running_last(both, ["v", "kind", "k"], "knot", "knot", []).where("kind = 1")
    low = lookup(knots.orderBy("k").limit(1).select(F.col("knot.r").alias("low")))
    a, b, s, t = F.col("knot.r"), F.col("knot.r2"), F.col("v") - F.col("knot.q"), F.col("knot.q2") - F.col("knot.q")
    endless = lambda c: F.abs(c) == F.lit(float("inf"))
    between = F.when(s == 0, a).when(endless(a), a).when(endless(b), b).otherwise((b - a) / t * s + a)
    mapped = found.crossJoin(low).select(F.col("v").alias("__v"), F.when(F.col("knot").isNull(), F.col("low")).when(F.col("knot.q2").isNull(), a).otherwise(between).alias("__u"))
    joined = df.join(mapped, value == F.col("__v"), "left")
    return joined.withColumn(out, F.when(F.isnan(value), value).otherwise(F.col("__u"))).drop("__v", "__u")


def save_quantiles(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").parquet(path)
