"""Splits, caps, slices, shuffles and first rows: all defined on an explicit key, none with a window over the whole table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackyard.operators.prefix import running_sums
from trackyard.sources.io import in_hash_buckets
from trackyard.sources.tables import lookup


def _rank(df: DataFrame, source: list[str], key: str) -> DataFrame:
    """(source, key, __r): rank from 1 by key within a source, by distributed running sums over these columns alone."""
    return running_sums(df.select(*source, key).withColumn("__one", F.lit(1).cast("long")), [F.col(key)], {"__r": "__one"}, source)


def _last_keys(df: DataFrame, source: str, key: str, limits: DataFrame) -> DataFrame:
    """(__s, __last): of each source the key of its last row within ``limits`` (__s, __limit), null if there is none. One row a source."""
    ranked = _rank(df, [source], key).join(limits, F.col(source).eqNullSafe(F.col("__s")))
    return lookup(ranked.groupBy(F.col("__s")).agg(F.max(F.when(F.col("__r") <= F.col("__limit"), F.col(key))).alias("__last")))


def _within(df: DataFrame, source: str, key: str, last: DataFrame) -> DataFrame:
    """``df`` with ``__in``: whether a row is within its source's limit."""
    joined = df.join(last, F.col(source).eqNullSafe(F.col("__s")), "left")
    return joined.withColumn("__in", F.coalesce(F.col(key) <= F.col("__last"), F.lit(False))).drop("__s", "__last")


def train_test_split(df: DataFrame, source: str, key: str = "event_id", test_size: float = 0.2, round_up: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """``split``: of each source the first int((1 - test_size) * n) rows by key are train, the rest test; ``round_up`` takes the next whole number.

    Keys are unique within a source. Ranks are made over (source, key) alone; rows themselves are neither sorted nor moved, only compared with their source's last key.
    ``keys`` is a table of the same sources and keys that is cheaper to read than ``df``: wide rows are then made once, when they are written.
    """
    narrow = df if keys is None else keys
    # The share of train rows as a ratio of whole numbers, so that no rounding of doubles moves an edge.
    keep = round((1 - test_size) * 1_000_000)
    limits = narrow.groupBy(F.col(source).alias("__s")).agg(F.count("*").alias("__n")).selectExpr("__s", f"(__n * {keep} + {999_999 if round_up else 0}) div 1000000 AS __limit")
    marked = _within(df, source, key, _last_keys(narrow, source, key, limits))
    return marked.withColumn("split", F.when(F.col("__in"), "train").otherwise("test")).drop("__in")


def cap_fraction(raw: DataFrame, kept: DataFrame, fractions: Mapping[str, float], source: str, key: str = "event_id") -> DataFrame:
    """Of ``kept`` (filtered rows of ``raw``) the first int(fraction * raw rows) of each source by key; sources without a fraction are whole."""
    n = raw.groupBy(F.col(source).alias("__s")).agg(F.count("*").alias("__n"))
    share = F.lit(1_000_000).cast("long")
    for s, f in fractions.items():
        share = F.when(F.col("__s") == s, F.lit(round(f * 1_000_000)).cast("long")).otherwise(share)
    limits = n.select("__s", (F.col("__n") * share).alias("__c")).selectExpr("__s", "__c div 1000000 AS __limit")
    return _within(kept, source, key, _last_keys(kept, source, key, limits)).where("__in").drop("__in")


def entry_stop(df: DataFrame, n: int, file: str, key: str = "event_id") -> DataFrame:
    """The first ``n`` rows over files in order of name, by key within a file: the window runs over one row per file."""
    counts = df.groupBy(F.col(file).alias("__s")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    limits = counts.select("__s", (F.lit(n) - F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__limit"))
    return _within(df, file, key, _last_keys(df, file, key, limits)).where("__in").drop("__in")


def stitch_versions(df: DataFrame, version: str = "version", epoch: str = "epoch") -> DataFrame:
    """Epochs of each version moved up by the epochs (largest + 1) of all versions before it. The window runs over one row per version."""
    spans = df.groupBy(F.col(version).alias("__v")).agg((F.max(epoch) + 1).alias("__span"))
    before = Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    shift = spans.select("__v", F.coalesce(F.sum("__span").over(before), F.lit(0)).alias("__shift"))
    return df.join(shift, F.col(version) == F.col("__v")).withColumn("global_epoch", F.col(epoch) + F.col("__shift")).drop("__v", "__shift")


def shuffle(df: DataFrame, seed: int | str, key: str = "event_id", buckets: int | None = None) -> DataFrame:
    """Rows in a seeded random order over partitions: one shuffle by hash ranges, and a sort in each (:func:`in_hash_buckets`)."""
    return in_hash_buckets(df, seed, key, buckets)


def contiguous_slices(df: DataFrame, n_jobs: int, key: str = "event_id") -> DataFrame:
    """``slice``: rows in order of key cut at int(linspace(0, n, jobs + 1)), at most one slice a row. Only the first keys of slices, one a job, go to the driver."""
    total = df.count()
    jobs = max(1, min(n_jobs, total))
    edges = [total * k // jobs + 1 for k in range(1, jobs)]
    firsts = [r[0] for r in _rank(df, [], key).where(F.col("__r").isin(edges)).select(key).collect()] if edges else []
    return df.withColumn("slice", sum(((F.col(key) >= x).cast("int") for x in firsts), F.lit(0)))


def local_index(df: DataFrame, values: str, index: str = "pos", value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """A row for each object of an event with its position, from 0; events without objects have none. ``values`` is an array, or a field of an array of records; ``keep`` are the columns beside (default: ``event_id``)."""
    return df.select(*(keep or ["event_id"]), F.posexplode(values).alias(index, value))


def with_local_index(df: DataFrame, jets: str = "jets", index: str = "pos") -> DataFrame:
    """Objects with their position as a field of their own."""
    return df.withColumn(jets, F.transform(jets, lambda j, i: j.withField(index, i)))


def first_n(df: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(key).limit(n)


def first_n_audit(df: DataFrame, n: int, source: str) -> DataFrame:
    """One row on such a slice: source, rows asked for, kept and there."""
    return df.agg(F.count("*").alias("total")).select(F.lit(source).alias("source"), F.lit(n).cast("long").alias("requested"), F.least(F.lit(n).cast("long"), F.col("total")).alias("kept"), "total")


def stable_metric_order(df: DataFrame) -> DataFrame:
    """Rows by tag, step and time; of one time by event_id."""
    return df.orderBy("tag", "step", "wall_time", "event_id")


def latest_file_rows(df: DataFrame, keys: list[str], file: str = "file", modified: str = "modified") -> DataFrame:
    """Rows of the newest file of each group; of files of one time the last by name."""
    newest = df.groupBy(*keys).agg(F.max(F.struct(modified, file)).alias("__m")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(f"__m.{file}").alias("__file"))
    match = F.col(file) == F.col("__file")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(newest, match).drop("__file", *[f"__{k}" for k in keys])


def leading_k(df: DataFrame, k: int, jets: str = "jets") -> DataFrame:
    """The first ``k`` jets of each event."""
    return df.withColumn(jets, F.slice(jets, 1, k))


def sort_jets(df: DataFrame, by: str = "pt", jets: str = "jets") -> DataFrame:
    """Jets in falling order of a field; equal ones keep their order."""
    keyed = F.transform(jets, lambda j, i: F.struct((-j[by]).alias("k"), i.alias("i"), j.alias("j")))
    return df.withColumn(jets, F.transform(F.sort_array(keyed), lambda x: x["j"]))


def union_events(*tables: DataFrame) -> DataFrame:
    """Tables one after the other; differing columns are an error."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def full_from_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows as one table, with ``split``."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def merge_eras(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Eras of one sample as one table, with ``era``."""
    return union_events(*[t.withColumn("era", F.lit(e)) for e, t in tables.items()])
