"""Evaluation of classifiers and assignments: one grouped pass over events, then work on its small result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackyard.functions import columns as C
from trackyard.operators.prefix import running_sums
from trackyard.operators.tensors import CLASSES
from trackyard.sources.tables import lookup


def confusion_counts(df: DataFrame, truth: str = "signal", predicted: str = "predicted", weight: Column | None = None) -> DataFrame:
    """(true, pred, w): weights by true and predicted class. All argmax figures are made from these few rows."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(F.col(truth).cast("int").alias("true"), F.col(predicted).cast("int").alias("pred")).agg(F.sum(w).alias("w"))


def class_grid(spark) -> DataFrame:
    """All pairs of the nine classes."""
    n = max(CLASSES) + 1
    return spark.range(1, n).select(F.col("id").cast("int").alias("true"), F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("pred"))


def argmax_purity_efficiency(counts: DataFrame) -> DataFrame:
    """Per class: purity W(true & pred) / W(pred), efficiency W(true & pred) / W(true), 0 where the denominator is not above 0; and both yields."""
    grid = class_grid(counts.sparkSession).where(F.col("true") == F.col("pred")).select(F.col("true").alias("class"))
    w, none = F.col("w"), F.lit(0.0)
    hit = F.when(F.col("true") == F.col("pred"), w).otherwise(none)
    as_pred = F.struct(F.col("pred").alias("class"), hit.alias("hit"), w.alias("n_region"), none.alias("n_target"))
    as_true = F.struct(F.col("true").alias("class"), none.alias("hit"), none.alias("n_region"), w.alias("n_target"))
    names = ("hit", "n_region", "n_target")
    # Both margins of one grouping: ``counts`` is read once.
    sums = counts.select(F.explode(F.array(as_pred, as_true)).alias("r")).select("r.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in names])
    joined = grid.join(sums, "class", "left").select("class", *[F.coalesce(c, none).alias(c) for c in names])
    return joined.select("class", C.ratio(F.col("hit"), F.col("n_region")).alias("purity"), C.ratio(F.col("hit"), F.col("n_target")).alias("efficiency"), "n_region", "n_target")


def weighted_composition(df: DataFrame, region: str, truth: str = "signal", weight: str = "weight") -> DataFrame:
    """Weight of each true class in each region, where above 0."""
    return df.groupBy(F.col(region).alias("region"), F.col(truth).alias("true")).agg(F.sum(weight).alias("w")).where("w > 0")


def region_purity_efficiency(rows: DataFrame, df: DataFrame, truth: str = "signal", weight: str = "weight") -> DataFrame:
    """Purity and efficiency of overlapping regions for their target class: ``rows`` has a row for each event and region it is in."""
    inside = rows.groupBy("region", "target").agg(F.sum(weight).alias("n_region"), F.sum(F.when(F.col(truth) == F.col("target"), F.col(weight)).otherwise(0.0)).alias("hit"))
    target = df.groupBy(F.col(truth).cast("int").alias("target")).agg(F.sum(weight).alias("n_target"))
    joined = inside.join(target, "target", "left").withColumn("n_target", F.coalesce("n_target", F.lit(0.0)))
    return joined.select("region", "target", C.ratio(F.col("hit"), F.col("n_region")).alias("purity"), C.ratio(F.col("hit"), F.col("n_target")).alias("efficiency"), "n_region", "n_target")


def confusion_matrix(counts: DataFrame, norm: str | None = None) -> DataFrame:
    """(true, pred, value) over all 9 x 9 pairs, normalised over 'true' rows, 'pred' columns or not; empty rows and columns give 0."""
    full = class_grid(counts.sparkSession).join(counts, ["true", "pred"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    if norm is None:
        return full.select("true", "pred", F.col("w").alias("value"))
    total = F.sum("w").over(Window.partitionBy(norm))
    return full.select("true", "pred", F.when(total != 0, F.col("w") / F.when(total != 0, total)).otherwise(0.0).alias("value"))


def classification_report(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each class; 0 where undefined."""
    x = argmax_purity_efficiency(counts)
    f1 = C.ratio(2 * F.col("purity") * F.col("efficiency"), F.col("purity") + F.col("efficiency"))
    return x.select("class", F.col("purity").alias("precision"), F.col("efficiency").alias("recall"), f1.alias("f1"), F.col("n_target").alias("support"))


def score_histogram(df: DataFrame, score: str, by: str, bins: int = 50, weight: str = "weight", density: bool = False) -> DataFrame:
    """(by, bin, value): weights by bin of [0, 1]; values outside are dropped. ``density`` has unit area."""
    rows = df.withColumn("bin", C.histogram_bin(F.col(score), 0.0, 1.0, bins)).where("bin IS NOT NULL").groupBy(by, "bin").agg(F.sum(weight).alias("value"))
    if density:
        rows = rows.withColumn("value", F.col("value") * bins / F.sum("value").over(Window.partitionBy(by)))
    return rows


def count_histogram(df: DataFrame, count: Column, low: int, high: int, weight: str = "weight") -> DataFrame:
    """Weights by object count in bins [low, low + 1), ..., the last one [high - 1, high]."""
    n = count.cast("int")
    return df.withColumn("bin", F.when((n >= low) & (n <= high), F.least(n, F.lit(high - 1)))).where("bin IS NOT NULL").groupBy("bin").agg(F.sum(weight).alias("value"))


def score_2d_hist(df: DataFrame, a: str, b: str, bins: int = 10, weight: str = "weight", floor: float = 1e-5) -> DataFrame:
    """(bin_a, bin_b, value) of two scores over [0, 1]; values below ``floor`` are null."""
    rows = df.withColumns({"bin_a": C.histogram_bin(F.col(a), 0.0, 1.0, bins), "bin_b": C.histogram_bin(F.col(b), 0.0, 1.0, bins)}).where("bin_a IS NOT NULL AND bin_b IS NOT NULL")
    sums = rows.groupBy("bin_a", "bin_b").agg(F.sum(weight).alias("value"))
    return sums.withColumn("value", F.when(F.col("value") >= floor, F.col("value")))


def score_correlation(df: DataFrame, names: Sequence[str], by: str) -> DataFrame:
    """(by, a, b, corr): Pearson correlation of each pair of scores; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = df.groupBy(by).agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(by, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("r")).select(by, "r.*")


def two_classes(df: DataFrame, scores: Mapping[int, str], truth: str = "signal", weight: str = "weight") -> DataFrame:
    """(is_true, score, weight) of the events of two classes alone: the first is the truth, its score its share of both. ``scores`` are the codes and score columns of the two."""
    (code, first), (other, second) = scores.items()
    rows = df.where(F.col(truth).isin(code, other))
    return rows.select((F.col(truth) == code).alias("is_true"), F.try_divide(F.col(first), F.col(first) + F.col(second)).alias("score"), F.col(weight).alias("weight"))


def named_scores(df: DataFrame, scores: Sequence[str], is_true: Column, weight: str = "weight") -> DataFrame:
    """(score_name, is_true, score, weight): a row for each event and score column, all against one truth."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("score_name"), F.col(c).cast("double").alias("score")) for c in scores]))
    return df.select(is_true.alias("is_true"), F.col(weight).alias("weight"), rows.alias("__r")).select("__r.score_name", "is_true", "__r.score", "weight")


def roc_points(df: DataFrame, by: str | None = None, score: str = "score", truth: str = "is_true", weight: str = "weight") -> DataFrame:
    """(by, score, fpr, tpr): a point for each distinct score, from high to low. Weights are summed by score before any order is made."""
    groups = [by] if by else []
    w = F.col(weight)
    distinct = df.groupBy(*groups, score).agg(F.sum(F.when(F.col(truth), w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(truth), 0.0).otherwise(w)).alias("n"))
    run = running_sums(distinct, [F.desc(score)], {"tp": "p", "fp": "n"}, groups)
    totals = lookup(run.groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")))
    joined = run.join(totals, F.col(by).eqNullSafe(F.col(f"__{by}"))) if by else run.crossJoin(totals)
    return joined.select(*groups, score, F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"), "p", "n", "tp", "fp", "pos", "neg")


def auc(points: DataFrame, by: str | None = None) -> DataFrame:
    """Area under the curve by trapezoids: each point's step in fpr times the mean of its tpr and the one before."""
    groups = [by] if by else []
    step = F.try_divide("n", "neg") * (F.col("tp") - F.col("p") / 2) / F.col("pos")
    return points.groupBy(*groups).agg(F.sum(step).alias("auc"))


def binned_significance(df: DataFrame, score: str, signal: Column, bins: int = 30, weight: str = "weight") -> DataFrame:
    """S / sqrt(B) in bins [low, high) of [0, 1]; 0 where B is not above 0. A score of 1 is in no bin."""
    x = F.col(score)
    rows = df.where((x >= 0) & (x < 1)).withColumn("bin", F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int"))
    sums = rows.groupBy("bin").agg(F.sum(F.when(signal, F.col(weight)).otherwise(0.0)).alias("s"), F.sum(F.when(signal, 0.0).otherwise(F.col(weight))).alias("b"))
    return sums.select("bin", C.s_over_root_b(F.col("s"), F.col("b")).alias("value"))


def cumulative_significance(df: DataFrame, score: str, signal: Column, points: int = 100, weight: str = "weight") -> DataFrame:
    """S / sqrt(B) of events with a score over each of ``points`` thresholds from 0 to 1.

    An event counts for the thresholds below its score: it falls into one cell, and sums run down over the cells.
    """
    last = points - 1
    k = F.least(F.ceil(F.col(score) * last) - 1, F.lit(last)).cast("int")
    cells = df.where(F.col(score) > 0).groupBy(k.alias("k")).agg(F.sum(F.when(signal, F.col(weight)).otherwise(0.0)).alias("s"), F.sum(F.when(signal, 0.0).otherwise(F.col(weight))).alias("b"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.join(cells, "k", "left").select("k", F.sum(F.coalesce("s", F.lit(0.0))).over(down).alias("s"), F.sum(F.coalesce("b", F.lit(0.0))).over(down).alias("b"))
    return sums.select("k", (F.col("k") / F.lit(float(last))).alias("threshold"), C.s_over_root_b(F.col("s"), F.col("b")).alias("value"))


def assignment_efficiency(df: DataFrame, pairs: dict[str, Sequence[str]], true: str = "true", pred: str = "pred") -> DataFrame:
    """Share of events with all daughters of a particle right, in their order."""
    out = []
    for particle, daughters in pairs.items():
        same = F.lit(True)
        for d in daughters:
            same = same & (F.col(f"{true}.{particle}.{d}") == F.col(f"{pred}.{particle}.{d}"))
        out.append(F.avg(same.cast("double")).alias(particle))
    return df.agg(*out)


def swap_counts(df: DataFrame, particle: str, a: str, b: str, true: str = "true", pred: str = "pred") -> DataFrame:
    """Events where two daughters are exchanged, where each differs, and the share right up to the exchange."""
    t, p = f"{true}.{particle}", f"{pred}.{particle}"
    swapped = (F.col(f"{t}.{a}") == F.col(f"{p}.{b}")) & (F.col(f"{t}.{b}") == F.col(f"{p}.{a}"))
    same = (F.col(f"{t}.{a}") == F.col(f"{p}.{a}")) & (F.col(f"{t}.{b}") == F.col(f"{p}.{b}"))
    n = lambda c: F.sum(c.cast("long"))
    return df.agg(n(swapped).alias("swapped"), n(F.col(f"{t}.{a}") != F.col(f"{p}.{a}")).alias("first_differs"), n(F.col(f"{t}.{b}") != F.col(f"{p}.{b}")).alias("second_differs"), F.avg((same | swapped).cast("double")).alias("either_way"))


def weighted_quantiles(df: DataFrame, x: str, weight: str, n: int) -> DataFrame:
    """(k, quantile, reference): x at ``n`` equally spaced shares of the cumulative weight, linear between values.

    Each distinct value emits the shares that fall between the share before it and its own: no join by range. Negative weights are an error.
    """
    w = F.when(F.col(weight) < 0, F.raise_error(F.lit("negative weights have no quantiles")).cast("double")).otherwise(F.col(weight))
    distinct = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.sum(w).alias("w")).where("w > 0")
    run = running_sums(distinct, [F.col("x")], {"cum": "w"}, part="__g")
    total = run.agg(F.sum("w").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))
    # One row of totals.
    shares = run.crossJoin(F.broadcast(total)).withColumn("share", F.col("cum") / F.col("total"))
    before = Window.partitionBy("__g").orderBy("x")
    parts = shares
    edge = parts.groupBy("__g").agg(F.max(F.struct("x", "share")).alias("e"))
    earlier = edge.select((F.col("__g")).alias("__h"), F.lag("e").over(Window.orderBy("__g")).alias("__e"))
    parts = parts.join(F.broadcast(earlier), F.col("__g") == F.col("__h"))
    prev = F.coalesce(F.lag(F.struct("x", "share")).over(before), F.col("__e"))
    rows = parts.withColumn("prev", prev)
    step = float(n - 1)
    low = F.when(F.col("prev").isNull(), F.lit(-1)).otherwise(F.floor(F.col("prev.share") * step))
    high = F.when(F.col("x") == F.col("most"), F.lit(n - 1)).otherwise(F.floor(F.col("share") * step))
    rows = rows.withColumn("k", F.explode(F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))))
    p = F.col("k") / step
    between = F.col("prev.x") + (F.col("x") - F.col("prev.x")) * (p - F.col("prev.share")) / (F.col("share") - F.col("prev.share"))
    value = F.when(F.col("prev").isNull(), F.col("x")).when(p >= F.col("share"), F.col("x")).otherwise(between)
    return rows.select(F.col("k").cast("int").alias("k"), value.alias("quantile"), p.alias("reference"))


def require_uniform(hist: DataFrame, bins: int, tolerance: float) -> DataFrame:
    """:func:`uniformity`, where a bin further than ``tolerance`` from flat is an error."""
    found = uniformity(hist, bins)
    off = F.greatest("over", "under") > tolerance
    return found.withColumn("over", F.when(off, F.raise_error(F.concat(F.lit("not uniform: over by "), F.col("over").cast("string"), F.lit(", under by "), F.col("under").cast("string"))).cast("double")).otherwise(F.col("over")))


def uniformity(hist: DataFrame, bins: int = 100) -> DataFrame:
    """Largest distance of a histogram (bin, value) from flat, as a share of the mean bin."""
    mean = F.sum("value") / F.lit(float(bins))
    return hist.agg((F.max("value") / mean - 1).alias("over"), (1 - F.min("value") / mean).alias("under"), F.count("*").alias("filled"))
