"""Filters and predicates on events, scores and metric series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.functions import columns as C

#: Cuts of the analysis regions. Fixed values.
THRESHOLDS = {"ttlf_low": 0.2, "ttlf_high": 0.3, "tthbb_low": 0.6, "tthbb_high": 0.8, "qcd_high": 0.001}


def min_jets(df: DataFrame, n: int, jets: str = "jets") -> DataFrame:
    """Events with at least ``n`` jets."""
    if jets not in df.columns:
        raise ValueError(f"no collection {jets}")
    return df.where(F.size(f"{jets}.pt") >= n)


def fully_matched(df: DataFrame, prov: str = "jets.prov", channel: str = "hadronic") -> DataFrame:
    """Events with all daughters matched: six jets, two from the Higgs, three from each top; in the one-lepton channel one from the leptonic top."""
    p = F.col(prov)
    second = C.count_of(p, 6, 3) == 3 if channel == "hadronic" else C.count_of(p, 3) == 1
    least = 6 if channel == "hadronic" else 0
    return df.where((C.count_of(p, 1, 2, 3, 5, 6) >= least) & (C.count_of(p, 1) == 2) & (C.count_of(p, 5, 2) == 3) & second)


def apply_mask(df: DataFrame, name: str) -> DataFrame:
    """Events that pass a stored mask; null fails."""
    return df.where(F.col(f"mask_{name}"))


def source_filter(df: DataFrame, groups: Mapping[str, str], path: str = "path", out: str = "group") -> DataFrame:
    """Rows whose source holds the substring of a group, with the group's name; the first that fits."""
    found = F.coalesce(*[F.when(F.contains(F.col(path), F.lit(part)), F.lit(name)) for name, part in groups.items()])
    return df.withColumn(out, found).where(F.col(out).isNotNull())


def true_class_subset(df: DataFrame, classes: Sequence[int], truth: str = "signal") -> DataFrame:
    return df.where(F.col(truth).isin(*classes))


def score_slices(df: DataFrame, edges: Sequence[float], score: str) -> DataFrame:
    """A row for each event and slice between consecutive edges, both excluded."""
    slices = F.array(*[F.struct(F.lit(k).alias("slice"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    return df.withColumn("__s", F.explode(slices)).where((F.col(score) > F.col("__s.low")) & (F.col(score) < F.col("__s.high"))).select(*df.columns, "__s.slice")


def _below(x: Column, cut: float) -> Column:
    return ~F.isnan(x) & (x < cut)


def _above(x: Column, cut: float) -> Column:
    return ~F.isnan(x) & (x > cut)


def cut_regions(df: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """A row for each event and region that it is in, with the region's target class. NaN scores fail every cut."""
    t = {**THRESHOLDS, **(thresholds or {})}
    veto = _below(F.col("qcd"), t["qcd_high"])
    regions = (
        ("inclusive", F.lit(True), 1),
        ("QCD veto", veto, 1),
        ("SR ttHbb", veto & _below(F.col("ttlf"), t["ttlf_low"]) & _above(F.col("tthbb"), t["tthbb_high"]), 1),
        ("CR ttlf", veto & _above(F.col("ttlf"), t["ttlf_high"]) & _below(F.col("tthbb"), t["tthbb_low"]), 3),
    )
    rows = F.array_compact(F.array(*[F.when(mask, F.struct(F.lit(name).alias("region"), F.lit(target).alias("target"))) for name, mask, target in regions]))
    return df.withColumn("__r", F.explode(rows)).select(*df.columns, "__r.*")


def region_grid(df: DataFrame, ttlf: Sequence[float], tthbb: Sequence[float], qcd_high: float = THRESHOLDS["qcd_high"]) -> DataFrame:
    """A row for each event, kind of region (SR, CR) and grid point that it is in: an array of fixed points, no join."""
    points = [(a, b) for a in ttlf for b in tthbb]
    veto = _below(F.col("qcd"), qcd_high)
    point = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.lit(float(a)).alias("ttlf_cut"), F.lit(float(b)).alias("tthbb_cut"))
    found = [F.when(veto & _below(F.col("ttlf"), a) & _above(F.col("tthbb"), b), point("SR", a, b)) for a, b in points]
    found += [F.when(veto & _above(F.col("ttlf"), a) & _below(F.col("tthbb"), b), point("CR", a, b)) for a, b in points]
    return df.withColumn("__p", F.explode(F.array_compact(F.array(*found)))).select(*df.columns, "__p.*")


def epoch_cap(df: DataFrame, most: int, epoch: str = "epoch") -> DataFrame:
    return df.where(F.col(epoch) <= most)


def filter_tags(df: DataFrame, keys: Sequence[str], tag: str = "tag") -> DataFrame:
    """Series whose tag holds any of the keys."""
    return df.where(F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(F.col(tag), k)))
