"""Multiplicity statistics, data quality checks, reweighting ratios and summaries of metric series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackyard.functions import columns as C
from trackyard.operators.prefix import running_sums

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def multiplicity(df: DataFrame, keys: Sequence[str], count: Column) -> DataFrame:
    """(keys, n, events): events for each object count. All multiplicity figures are made from these few rows."""
    return df.groupBy(*keys, count.cast("int").alias("n")).agg(F.count("*").alias("events"))


def _cumulated(hist: DataFrame, keys: Sequence[str], max_bin: int) -> DataFrame:
    """``hist`` with the events up to each bin, and all of its keys. A window over the few rows of a histogram."""
    run = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.when(F.col("n").between(0, max_bin), F.col("events")).otherwise(0)
    return hist.withColumns({"__cum": F.sum(inside).over(run), "__all": F.sum("events").over(Window.partitionBy(*keys))})


def _percentiles(max_bin: int, quantiles: Mapping[str, float]) -> list[Column]:
    out = []
    for name, q in quantiles.items():
        found = F.min(F.when((F.col("__cum") > q * (F.col("__all") - 1)) & F.col("n").between(0, max_bin), F.col("n")))
        value = F.min("n") if q <= 0 else F.max("n") if q >= 1 else F.coalesce(found, F.greatest(F.lit(max_bin), F.max("n")))
        out.append(value.cast("double").alias(name))
    return out


def discrete_percentiles(hist: DataFrame, keys: Sequence[str], max_bin: int = 40, quantiles: Mapping[str, float] = QUANTILES) -> DataFrame:
    """The least count k whose cumulative number of events is over q * (events - 1); the minimum at q <= 0, the maximum at q >= 1 and beyond the bins."""
    return _cumulated(hist, keys, max_bin).groupBy(*keys).agg(*_percentiles(max_bin, quantiles))


def exact_quantiles(hist: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of a multiplicity, exact: from the events of each count, not from a row an event."""
    q = hist.groupBy(*keys).agg(F.percentile("n", [float(x) for x in quantiles.values()], F.col("events")).alias("__q"))
    return q.select(*keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(quantiles)])


def multiplicity_stats(hist: DataFrame, keys: Sequence[str], max_bin: int = 40) -> DataFrame:
    """n_events, min, max, mean, percentiles, shares of 16 and more and of over 16 objects, and events beyond ``max_bin``, from one pass over the histogram."""
    e = F.col("events")
    total = F.sum("events")
    return _cumulated(hist, keys, max_bin).groupBy(*keys).agg(
        total.alias("n_events"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), (F.sum(F.col("n") * e) / total).alias("mean"),
        (F.sum(F.when(F.col("n") >= 16, e).otherwise(0)) / total).alias("frac_ge16"),
        (F.sum(F.when(F.col("n") > 16, e).otherwise(0)) / total).alias("frac_gt16"),
        F.sum(F.when(F.col("n") > max_bin, e).otherwise(0)).alias("overflow"),
        *_percentiles(max_bin, QUANTILES),
    )


def overall_and_per_chunk(hist: DataFrame, chunk: str) -> DataFrame:
    """The histogram for each chunk and, with a null chunk, over all: one grouping-sets pass."""
    return hist.rollup("n", chunk).agg(F.sum("events").alias("events"), F.grouping("n").alias("__g")).where("__g = 0").select(chunk, "n", "events")


def multiplicity_hist(hist: DataFrame, keys: Sequence[str], max_bin: int = 40) -> DataFrame:
    """A row for each key and bin 0 .. max_bin; empty bins have 0."""
    bins = hist.select(*keys).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(max_bin)))) if keys else hist.sparkSession.range(max_bin + 1).select(F.col("id").cast("int").alias("n"))
    return bins.join(hist, [*keys, "n"], "left").select(*keys, "n", F.coalesce("events", F.lit(0)).alias("events"))


def event_fractions(df: DataFrame, names: Mapping[int, str], code: str) -> DataFrame:
    """Events and percent of each code, zero classes included."""
    counts = df.groupBy(code).agg(F.count("*").alias("events"))
    spark = df.sparkSession
    table = spark.createDataFrame(list(names.items()), f"{code} int, label string")
    joined = F.broadcast(table).join(counts, code, "right_outer").unionByName(table.join(counts, code, "left_anti").withColumn("events", F.lit(0).cast("long")))
    percent = 100 * F.col("events") / F.sum("events").over(Window.partitionBy())
    return joined.withColumn("percent", percent)


def njet_ratios(df: DataFrame, masks: Mapping[str, str], njet: str = "njet", weight: str = "weight", group: str = "dctr") -> DataFrame:
    """(mask, njet, ratio) for njet 4, 5, 6 and 7 and more: weights of group 1 over those of group 0."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("mask"), F.col(c).alias("inside")) for name, c in masks.items()]))
    w = F.col(weight)
    sums = (
        df.where(F.col(njet) >= 4).select(F.least(F.col(njet), F.lit(7)).alias("njet"), weight, group, rows.alias("m")).where("m.inside")
        .groupBy("m.mask", "njet").agg(F.sum(F.when(F.col(group) == 1, w)).alias("num"), F.sum(F.when(F.col(group) == 0, w)).alias("den"))
    )
    return sums.select("mask", "njet", F.try_divide("num", "den").alias("ratio"))


def nonfinite_report(long: DataFrame, k: int = 16) -> DataFrame:
    """Long rows (dataset, event_id, pos, value): NaN, infinities, finite values and percent bad of each dataset, and its first ``k`` bad places as text."""
    kind = C.nonfinite_kind(F.col("value"))
    marked = long.withColumn("kind", kind)
    n = lambda x: F.sum((F.col("kind") == x).cast("long"))
    counts = marked.groupBy("dataset").agg(F.count("*").alias("total"), n("nan").alias("n_nan"), n("+inf").alias("n_posinf"), n("-inf").alias("n_neginf"), n("finite").alias("n_finite"))
    return counts.withColumn("bad_percent", 100 * (F.col("n_nan") + F.col("n_posinf") + F.col("n_neginf")) / F.col("total"))


def fill_counts(long: DataFrame) -> DataFrame:
    """What a repair of long rows (dataset, event_id, pos, value) would do, without doing it: values seen and values replaced of each dataset."""
    return long.groupBy("dataset").agg(F.count("*").alias("n_values"), F.sum(C.is_nonfinite(F.col("value")).cast("long")).alias("n_filled"))


def examples_top_k(long: DataFrame, k: int = 16) -> DataFrame:
    """The first ``k`` bad places (event_id, pos) of each dataset, kept map-side: a window limit per dataset."""
    first = F.row_number().over(Window.partitionBy("dataset").orderBy("event_id", "pos"))
    return long.where(C.is_nonfinite(F.col("value"))).withColumn("k", first).where(F.col("k") <= k).select("dataset", "k", "event_id", "pos")


def misordered(pt: Column) -> Column:
    """True where a pt is larger than the one before it."""
    n = F.size(pt)
    return (n >= 2) & ~F.forall(F.zip_with(F.slice(pt, 1, F.greatest(n - 1, F.lit(0))), F.slice(pt, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a >= b), lambda x: x)


def ordering_check(df: DataFrame, n: int | None = None, jets: str = "jets", key: str = "event_id") -> DataFrame:
    """Events looked at (all, or the first ``n`` by key) and how many have jets out of order."""
    rows = df.select(key, F.col(f"{jets}.pt").alias("pt"))
    return (rows if n is None else rows.orderBy(key).limit(n)).agg(F.count("*").alias("events"), F.sum(misordered(F.col("pt")).cast("long")).alias("bad"))


def clipping_risk(df: DataFrame, keys: Sequence[str], max_index: int = 15, prov: str = "jets.prov") -> DataFrame:
    """Share of events with a matched jet (prov 0 or more) beyond ``max_index``."""
    beyond = F.exists(F.transform(prov, lambda p, i: (p >= 0) & (i > max_index)), lambda x: x)
    return df.groupBy(*keys).agg(F.avg(beyond.cast("double")).alias("risk"))


def feature_hist_by_rank(df: DataFrame, edges: Mapping[str, Sequence[float]], k: int = 8, jets: str = "jets") -> DataFrame:
    """(feature, rank, bin, count, density): histograms of the features of the first ``k`` jets by place; density has unit area over bin widths."""
    jet = F.slice(F.arrays_zip(*[F.col(f"{jets}.{name}").alias(name) for name in edges]), 1, k)
    rows = df.select(F.posexplode(jet).alias("rank", "jet"))
    widths = {name: F.array(*[F.lit(float(b - a)) for a, b in zip(e, e[1:], strict=False)]) for name, e in edges.items()}
    bins = [F.struct(F.lit(name).alias("feature"), C.edge_bin(F.col("jet")[name], e).alias("bin")) for name, e in edges.items()]
    # One pass over the events for all features.
    counts = rows.select("rank", F.explode(F.array(*bins)).alias("b")).where("b.bin IS NOT NULL").groupBy("b.feature", "rank", "b.bin").agg(F.count("*").alias("count"))
    width = F.coalesce(*[F.when(F.col("feature") == name, F.get(w, F.col("bin"))) for name, w in widths.items()])
    total = F.sum("count").over(Window.partitionBy("feature", "rank"))
    return counts.withColumn("density", F.col("count") / (total * width)).select("feature", "rank", "bin", "count", "density")


def epoch_mean(df: DataFrame, keys: Sequence[str] = ("tag", "epoch")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("value").alias("value"))


def metric_summary(df: DataFrame) -> DataFrame:
    """count, step range and value range of each tag."""
    return df.groupBy("tag").agg(F.count("*").alias("n"), F.min("step").alias("min_step"), F.max("step").alias("max_step"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def missing_tags(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(tag, present) of the expected tags."""
    names = df.sparkSession.createDataFrame([(t,) for t in expected], "tag string")
    return names.join(df.select("tag").distinct().withColumn("present", F.lit(True)), "tag", "left").select("tag", F.coalesce("present", F.lit(False)).alias("present"))


def best_value(df: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """The least value of tags that contain 'loss', the largest of others; NaN ignored."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return df.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high")).select(*keys, F.when(F.contains(F.lower("tag"), F.lit("loss")), F.col("low")).otherwise(F.col("high")).alias("best"))


def plot_bounds(df: DataFrame, keys: Sequence[str], low: float = 0.0, high: float = 1.0, pad: float = 0.05) -> DataFrame:
    """First and 99th percentile of finite values, widened by ``pad`` of their distance and held within [low, high]. Percentiles come from running counts over distinct values."""
    finite = df.where(~C.is_nonfinite(F.col("value"))).groupBy(*keys, "value").agg(F.count("*").alias("__n"))
    run = running_sums(finite, [F.col("value")], {"__cum": "__n"}, list(keys))
    totals = run.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg((F.sum("__n") - 1).alias("__last"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    at = {p: F.col("__last") * p for p in (0.01, 0.99)}
    # The value at a place is the least one whose running count is above it.
    value = lambda place: F.min(F.when(F.col("__cum") > place, F.col("value")))
    ends = run.join(totals, match).groupBy(*keys, "__last").agg(*[value(f(at[p])).alias(f"{n}{k}") for k, p in enumerate(at) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    a, b = (F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (at[p] - F.floor(at[p])) for k, p in enumerate(at))
    q = ends.select(*keys, a.alias("a"), b.alias("b")).withColumn("margin", (F.col("b") - F.col("a")) * pad)
    return q.select(*keys, F.greatest(F.lit(low), F.col("a") - F.col("margin")).alias("lower"), F.least(F.lit(high), F.col("b") + F.col("margin")).alias("upper"))


def array_shape_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and largest length of each array column, its type, and whether all rows agree."""
    aggregated = df.agg(*[f(F.size(F.col(c))).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    kinds = [df.select(F.col(c)).schema[0].dataType.simpleString() for c in columns]
    rows = [F.struct(F.lit(c).alias("dataset"), F.lit(kind).alias("kind"), F.col(f"lo{k}").alias("least"), F.col(f"hi{k}").alias("most"), (F.col(f"lo{k}") == F.col(f"hi{k}")).alias("even")) for k, (c, kind) in enumerate(zip(columns, kinds, strict=True))]
    return aggregated.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def weight_invariant(df: DataFrame, data: str = "is_data") -> DataFrame:
    """Data rows, and how many of them have another weight than before."""
    changed = F.col(data) & ~F.col("weight").eqNullSafe(F.col("weight_original"))
    return df.agg(F.sum(F.col(data).cast("long")).alias("data_rows"), F.sum(changed.cast("long")).alias("changed"))


def require_weight_invariant(df: DataFrame, data: str = "is_data") -> DataFrame:
    """``df``, where a data row whose weight was changed is an error."""
    changed = F.col(data) & ~F.col("weight").eqNullSafe(F.col("weight_original"))
    return df.withColumn("weight", F.when(changed, F.raise_error(F.lit("a data weight was changed")).cast("double")).otherwise(F.col("weight")))


def unmatched_fraction(df: DataFrame, by: Sequence[str], codes: str = "jets.prov", unmatched: int = -1, weight: str = "weight") -> DataFrame:
    """(by, unmatched, mean_weight): the share of objects without a match, and the mean of the positive weights of events. One grouped pass: objects are counted in their event, not exploded."""
    n, lost = F.size(codes), F.size(F.filter(codes, lambda c: c == unmatched))
    own = df.select(*by, n.alias("n"), lost.alias("lost"), F.when(F.col(weight) > 0, F.col(weight)).alias("w"))
    return own.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("n") > 0, F.col("lost"))).cast("double"), F.sum(F.when(F.col("n") > 0, F.col("n")))).alias("unmatched"), F.avg("w").alias("mean_weight"))


def weight_histogram(df: DataFrame, by: Sequence[str] = (), weight: str = "weight", low: float = -1.0, high: float = 1.0, bins: int = 50) -> DataFrame:
    """(by, bin, low, high, events): events in equal bins of their weight, the last with its right edge, and those below (bin -1) and above (bin ``bins``); NaN and null weights have a null bin. Bins without events have no row."""
    w = F.col(weight)
    at = F.coalesce(C.histogram_bin(w, low, high, bins), F.when(w < low, -1).when((w > high) & ~F.isnan(w), bins))
    width = (high - low) / bins
    edges = {"low": F.when(F.col("bin") >= 0, F.lit(low) + F.col("bin") * F.lit(width)), "high": F.when(F.col("bin") < bins, F.lit(low) + (F.col("bin") + 1) * F.lit(width))}
    return df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("events")).select(*by, "bin", *[c.alias(n) for n, c in edges.items()], "events")
