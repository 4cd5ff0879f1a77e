"""Event building: from flat columns and long object rows to nested event records with weights, labels and truth matching."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Data-taking years that a path may name. Fixed values.
YEARS = ("2016_PreVFP", "2016_PostVFP", "2017", "2018", "2022_preEE", "2022_postEE", "2023_preBPix", "2023_postBPix", "2024", "2025")
#: pt of an object without a match. Fixed value.
UNMATCHED = -999


def select_features(df: DataFrame, features: Mapping[str, Mapping[str, str]], overrides: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Columns ``<Collection>_<source>`` as ``<Collection>_<name>``; ``overrides`` of one sample go over the common map. Other columns stay."""
    merged = {c: {**fields, **(overrides or {}).get(c, {})} for c, fields in features.items()}
    merged |= {c: dict(f) for c, f in (overrides or {}).items() if c not in merged}
    used = {f"{c}_{source}" for c, fields in merged.items() for source in fields.values()}
    if missing := used - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    own = [F.col(f"{c}_{source}").alias(f"{c}_{name}") for c, fields in merged.items() for name, source in fields.items()]
    return df.select(*[c for c in df.columns if c not in used], *own)


def first_existing(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {list(names)} is a column")


def pad_fields(df: DataFrame, collection: str, fields: Mapping[str, float], like: str) -> DataFrame:
    """Constant fields of a collection, with the shape of its field ``like``."""
    is_list = dict(df.dtypes)[f"{collection}_{like}"].startswith("array")
    make = lambda v: F.transform(F.col(f"{collection}_{like}"), lambda x: F.lit(v)) if is_list else F.lit(v)
    return df.withColumns({f"{collection}_{k}": make(float(v)) for k, v in fields.items()})


def zip_collection(df: DataFrame, collection: str, fields: Sequence[str]) -> DataFrame:
    """Parallel arrays ``<collection>_<field>`` as one array of records; a row with arrays of unequal length is an error."""
    columns = [F.col(f"{collection}_{f}") for f in fields]
    depth = {dict(df.dtypes)[f"{collection}_{f}"].startswith("array") for f in fields}
    if len(depth) > 1:
        raise ValueError(f"fields of {collection} differ in depth")
    if not depth.pop():
        return df.withColumn(collection, F.struct(*[c.alias(f) for c, f in zip(columns, fields, strict=True)])).drop(*[f"{collection}_{f}" for f in fields])
    same = F.greatest(*[F.size(c) for c in columns]) == F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.lit(True)
    named = F.arrays_zip(*[c.alias(f) for c, f in zip(columns, fields, strict=True)])
    checked = F.when(same, named).otherwise(F.raise_error(F.lit(f"arrays of {collection} differ in length")))
    return df.withColumn(collection, checked).drop(*[f"{collection}_{f}" for f in fields])


def nest_objects(events: DataFrame, objects: DataFrame, name: str, fields: Sequence[str], key: str = "event_id", order: str = "pos") -> DataFrame:
    """Long object rows gathered into an array of records on each event, in order; events without objects have an empty array.

    What is gathered has a row for nearly every event, and lies by key already: a merge join moves the events to it, where an estimate from the bytes of files might send all of it to every task.
    """
    record = F.struct(order, *fields)
    nested = objects.groupBy(key).agg(F.sort_array(F.collect_list(record)).alias(name))
    kind = nested.schema[name].dataType.simpleString()
    joined = events.join(nested.hint("merge"), key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return joined.withColumn(name, F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields])))


def unflatten(values: DataFrame, counts: DataFrame, key: str = "event_id") -> DataFrame:
    """Object rows of a flat accumulator: values (at, value) in order and counts (key, first, n) per event give (key, pos, value)."""
    return counts.where("n > 0").select(key, "first", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).withColumn("at", F.col("first") + F.col("pos")).join(values, "at").select(key, "pos", "value")


def to_singleton(df: DataFrame, name: str) -> DataFrame:
    """An array of exactly one record as that record; any other length is an error."""
    one = F.when(F.size(name) == 1, F.get(F.col(name), F.lit(0))).otherwise(F.raise_error(F.lit(f"{name} must hold one object per event")))
    return df.withColumn(name, one)


def attach_matching(df: DataFrame, jets: str = "jets", matched: str = "matched") -> DataFrame:
    """``matched`` and ``prov`` on each jet from the aligned matched collection: -999 is no match, with prov -1.

    Without the matched collection, the table is returned as it is, with a warning.
    """
    if matched not in df.columns:
        warnings.warn(f"no collection {matched}: jets keep no truth", stacklevel=2)
        return df
    kinds = df.schema[jets].dataType.elementType.names
    has = F.col(f"{matched}.pt")
    prov = F.col(f"{matched}.prov")

    def with_truth(jet, i):
        hit = F.coalesce(F.get(has, i) != UNMATCHED, F.lit(False))
        return F.struct(*[jet[f].alias(f) for f in kinds if f not in ("matched", "prov")], hit.alias("matched"), F.when(hit, F.get(prov, i)).otherwise(F.lit(-1)).cast("int").alias("prov"))

    return df.withColumn(jets, F.transform(jets, with_truth))


def null_unmatched(values: Column) -> Column:
    """The sentinel -999 as null."""
    return F.transform(values, lambda x: F.when(x != UNMATCHED, x))


def is_simulation(sample: Column) -> Column:
    return ~F.startswith(sample, F.lit("DATA"))


def normalize_genweights(df: DataFrame, sums: DataFrame, weight: str = "weight") -> DataFrame:
    """Simulated weights over the sum of generator weights of their ``dataset``; data keep theirs.

    ``sums`` (dataset, value) has one row a dataset and is joined, never collected.
    """
    own = sums.select(F.col("dataset").alias("__dataset"), F.col("value").alias("__sum"))
    joined = df.join(own, F.col("dataset") == F.col("__dataset"), "left")
    return joined.withColumn(weight, F.when(is_simulation(F.col("sample")), F.col(weight) / F.col("__sum")).otherwise(F.col(weight))).drop("__dataset", "__sum")


def assemble_event(df: DataFrame, collections: Sequence[str], scalars: Mapping[str, Sequence[str]]) -> DataFrame:
    """One record per event: collections as they are, groups of scalars as structs (``event.weight``)."""
    return df.select("event_id", *collections, *[F.struct(*names).alias(group) for group, names in scalars.items()])


def _single_hit(path: Column, keys: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(path, k))


def source_sample(df: DataFrame, keys: Sequence[str], path: str = "path", out: str = "sample") -> DataFrame:
    """Sample of a row: the one key that is part of its whole path. No hit or several is an error."""
    hits = _single_hit(F.col(path), keys)
    return df.withColumn(out, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit(f"{out}: no single match in "), F.col(path)))))


def source_year(df: DataFrame, path: str = "path", out: str = "year") -> DataFrame:
    """Data-taking year of a row, by the same rule."""
    return source_sample(df, YEARS, path, out)


def build_labels(df: DataFrame, mapping: Mapping[str, Sequence[str]], sample: str = "sample") -> DataFrame:
    """A 0/1 column for each label; samples that share a label add up to one."""
    return df.withColumns({label: F.col(sample).isin(*samples).cast("int") for label, samples in mapping.items()})


def encode_class(df: DataFrame, encodings: Mapping[str, Mapping[str, int]], sample: str = "sample") -> DataFrame:
    """An integer class for each encoding; a sample without a code is an error."""
    out = {}
    for name, codes in encodings.items():
        if not isinstance(codes, Mapping):
            raise ValueError(f"encoding {name} must map samples to codes")
        code = F.raise_error(F.concat(F.lit(f"{name}: no code for "), F.col(sample))).cast("int")
        for s, c in codes.items():
            code = F.when(F.col(sample) == s, F.lit(int(c))).otherwise(code)
        out[name] = code
    return df.withColumns(out)


def scale_weights(df: DataFrame, factors: Mapping[str, float], weight: str = "weight", sample: str = "sample") -> DataFrame:
    """Weights times the factor of their sample, which may be negative; a sample without one is an error."""
    factor = F.raise_error(F.concat(F.lit("no factor for "), F.col(sample))).cast("double")
    for s, f in factors.items():
        factor = F.when(F.col(sample) == s, F.lit(float(f))).otherwise(factor)
    return df.withColumn(weight, F.col(weight) * factor)


def default_weight(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Weight 1 where the table has none."""
    return df if weight in df.columns else df.withColumn(weight, F.lit(1.0))


def btag_collection(df: DataFrame, flag: str = "btag_M", jets: str = "jets", out: str = "bjets") -> DataFrame:
    """Jets that pass a working point, and a copy of the weight before any reweighting."""
    return df.withColumn(out, F.filter(jets, lambda j: j[flag] == 1)).withColumn("weight_original", F.col("weight"))
