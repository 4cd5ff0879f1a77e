"""Column expressions over arrays and scores, all within Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_nonfinite(x: Column) -> Column:
    """NaN or an infinity; false for null."""
    return F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(False))


def nonfinite_kind(x: Column) -> Column:
    """'nan', '+inf', '-inf' or 'finite'; null for null."""
    inf = float("inf")
    return F.when(F.isnan(x), "nan").when(x == F.lit(inf), "+inf").when(x == F.lit(-inf), "-inf").when(x.isNotNull(), "finite")


def pad_clip(values: Column, n: int, fill=0) -> Column:
    """The first ``n`` values, nulls and missing places filled."""
    filled = F.transform(values, lambda x: F.coalesce(x, F.lit(fill)))
    return F.slice(F.concat(filled, F.array_repeat(F.lit(fill), n)), 1, n)


def mask_from_pt(pt: Column) -> Column:
    """True where a padded pt is not 0; a NaN pt counts as an object."""
    return F.transform(pt, lambda x: x != 0)


def count_true(mask: Column) -> Column:
    """Number of true elements."""
    return F.size(F.filter(mask, lambda x: x))


def count_of(values: Column, *codes: int) -> Column:
    """Number of elements equal to one of the codes."""
    return F.size(F.filter(values, lambda x: x.isin(*codes)))


def index_of(codes: Column, code: int, nth: int = 0) -> Column:
    """Position of the nth element equal to ``code``; -1 if there is none."""
    at = F.filter(F.transform(codes, lambda p, i: F.when(p == code, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(at, F.lit(nth)), F.lit(-1)).cast("long")


def cap_index(x: Column, n: int, replacement: int = -1) -> Column:
    """An index of ``n`` or more becomes ``replacement``."""
    return F.when(x >= n, F.lit(replacement).cast("long")).otherwise(x)


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first on ties; NaN wins."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log1p_at(values: Column, apply: bool) -> Column:
    return F.transform(values, lambda x: F.log1p(x)) if apply else values


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin 0 .. bins - 1 of equal widths; the last one holds its right edge. Null outside the range and for NaN."""
    inside = (x >= low) & (x <= high) & ~F.isnan(x)
    width = (high - low) / bins
    return F.when(inside, F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1)).cast("int"))


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin of ascending edges; the last one holds its right edge. Null outside and for NaN."""
    n = len(edges) - 1
    above = sum(((x >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when((x >= edges[0]) & (x <= edges[n]) & ~F.isnan(x), above)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not above 0."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def s_over_root_b(s: Column, b: Column) -> Column:
    """s / sqrt(b), and 0 where b is not above 0."""
    return F.when(b > 0, s / F.sqrt(F.when(b > 0, b))).otherwise(F.lit(0.0))


def slug(name: Column) -> Column:
    """Lower-cased name, runs of other characters made one underscore, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(name, "[^0-9A-Za-z]+", "_"), F.lit("_")))


def tag_of_file(path: Column) -> Column:
    """Tag of a metric file: its base name without extension, '__' read as '/'."""
    return F.replace(F.regexp_extract(path, r"([^/]+)\.csv$", 1), F.lit("__"), F.lit("/"))


def file_of_tag(tag: Column) -> Column:
    """Base name of a tag's metric file."""
    return F.replace(tag, F.lit("/"), F.lit("__"))


def run_label(path: Column) -> Column:
    """Last folder of a path."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def run_number(path: Column) -> Column:
    """Number of a 'version_N' folder; null without one."""
    return F.when(path.rlike(r"version_\d+"), F.regexp_extract(path, r"version_(\d+)", 1).cast("long"))


def fill_nonfinite(values: Column, fill: float = 0.0) -> Column:
    """An array with NaN and infinities replaced."""
    return F.transform(values, lambda x: F.when(is_nonfinite(x), F.lit(fill)).otherwise(x))


def shuffle_key(seed: int | str, key: Column) -> Column:
    """What rows are ordered by in a seeded shuffle: the same in every run and engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))
