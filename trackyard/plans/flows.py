"""The three flows over the operators: event building, training sets, scoring with its report. Each is one plan over all samples and years."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.functions import columns as C
from trackyard.operators import build, evaluate, joins, order, scoring, select, tensors
from trackyard.sources import io, tables


def _strict(kind, values: Mapping):
    """A config from a mapping; unknown keys are errors."""
    names = {f.name for f in fields(kind)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown keys: {sorted(unknown)}; there are {sorted(names)}")
    return kind(**values)


@dataclass(frozen=True)
class EventConfig:
    """Event building: features by collection, overrides by sample, constant fields, and which collections hold one object."""

    features: Mapping[str, Mapping[str, str]]
    by_sample: Mapping[str, Mapping[str, Mapping[str, str]]] = field(default_factory=dict)
    pads: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    singles: Sequence[str] = ()
    matched: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, values: Mapping) -> EventConfig:
        return _strict(cls, values)


@dataclass(frozen=True)
class TrainingConfig:
    """Training sets: inputs by object, particles with targets, samples by label and code, weights, caps and the split."""

    inputs: Mapping[str, Sequence[str]]
    samples: Sequence[str]
    jets: str = "jets"
    particles: Sequence[str] = ()
    labels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    encodings: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    classification: Sequence[str] = ()
    weights_scale: Mapping[str, float] = field(default_factory=dict)
    max_frac_events: Mapping[str, float] = field(default_factory=dict)
    njet_min: int = 0
    njet_max: int = 16
    fully_matched: bool = False
    test_size: float = 0.2
    seed: int = 0

    @classmethod
    def of(cls, values: Mapping) -> TrainingConfig:
        return _strict(cls, values)


def build_events(flat: DataFrame, config: EventConfig, sums: DataFrame | None = None, sample: str | None = None) -> DataFrame:
    """Flat ntuple columns to nested events: features renamed, padded and zipped by collection, truth attached, weights normalised where ``sums`` (dataset, value) are given."""
    if sums is not None:
        flat = build.normalize_genweights(flat, sums)
    df = build.select_features(flat, config.features, config.by_sample.get(sample, {}))
    for collection, names in config.features.items():
        pads = config.pads.get(collection, {})
        if pads:
            df = build.pad_fields(df, collection, pads, next(iter(names)))
        df = build.zip_collection(df, collection, [*names, *pads])
        if collection in config.singles and dict(df.dtypes)[collection].startswith("array"):
            df = build.to_singleton(df, collection)
    for collection, matched in config.matched.items():
        df = build.attach_matching(df, collection, matched)
    return df


def training_set(events: DataFrame, config: TrainingConfig, path: str = "path", key: str = "event_id") -> DataFrame:
    """Rows of a training set with ``split``; :func:`write_training_set` puts them in a seeded random order: caps count raw rows and apply after the filters, the split is by sample."""
    if config.jets not in events.columns:
        raise ValueError(f"no collection {config.jets}")
    df = events if "sample" in events.columns else build.source_sample(events, config.samples, path)
    df = build.default_weight(df)
    kept = select.min_jets(df, config.njet_min, config.jets)
    if config.fully_matched:
        kept = select.fully_matched(kept, f"{config.jets}.prov")
    if config.max_frac_events:
        kept = order.cap_fraction(df, kept, config.max_frac_events, "sample", key)
    if config.weights_scale:
        kept = build.scale_weights(kept, config.weights_scale)
    kept = build.encode_class(build.build_labels(kept, config.labels), config.encodings)
    has_truth = "prov" in kept.schema[config.jets].dataType.elementType.names
    kept = tensors.assign_targets(kept, config.njet_max, f"{config.jets}.prov", config.particles) if has_truth and config.particles else tensors.unlabelled_targets(kept, config.particles or ("h",))
    kept = tensors.classification_columns(tensors.object_features(kept, config.inputs, config.njet_max, config.jets), config.classification)
    # Written once: counts, ranks, the sample of the sort and the sort itself read these rows.
    rows = order.train_test_split(tables.cut(kept.select(key, "sample", "inputs", "targets", "classifications", "weight")), "sample", key, config.test_size)
    return rows.select(F.col(key).alias("event_id"), "sample", "split", "inputs", "targets", "classifications", F.struct(F.col("weight").cast("float").alias("weight")).alias("weights"))


def write_training_set(events: DataFrame, config: TrainingConfig, target: str, **options) -> DataFrame:
    """A training set written by split, in a seeded random order; returns the counts beside it."""
    return io.write_training_set(training_set(events, config, **options), target, config.seed)


def score_and_report(rows: DataFrame, factory: Callable, vector: str | Mapping[str, str], truth: str = "signal", weight: str = "weight", thresholds: Mapping[str, float] | None = None, slices: tuple[str, int] | None = None) -> dict[str, DataFrame]:
    """Scores of all events and the report on them, as tables by name.

    ``vector`` is the column of a model with one input, or names of inputs to columns. Scores are written once, so that the model runs once for all figures; every event must have them once. With ``slices`` (path, number), for models of
    several inputs, they are made slice by slice under that path, and a run that was ended is taken up there.
    """
    if slices:
        scoring.score_slices(rows, factory, vector, *slices)
        scores = scoring.merged_slices(rows.sparkSession, slices[0]).drop("slice")
    else:
        scores = scoring.score_events(rows, factory, vector) if isinstance(vector, str) else scoring.score_inputs(rows, factory, vector)
    scored = tables.cut(joins.attach_scores(rows, scores, complete=True).drop("has_score"))
    wide = tensors.derived_scores(tensors.node_scores(scored)).withColumn("predicted", C.argmax(F.col("scores")))
    counts = tables.cut(evaluate.confusion_counts(wide, truth, "predicted", F.col(weight)))
    regions = select.cut_regions(wide, thresholds)
    return {
        "scored": wide,
        "purity": evaluate.argmax_purity_efficiency(counts),
        "confusion": evaluate.confusion_matrix(counts, "true"),
        "classes": evaluate.classification_report(counts),
        "regions": evaluate.region_purity_efficiency(regions, wide, truth, weight),
        "composition": evaluate.weighted_composition(regions, "region", truth, weight),
        "histogram": evaluate.score_histogram(wide, "tthbb", truth, weight=weight),
        "roc": evaluate.roc_points(tensors.truth_prediction(scored.select("event_id", truth, F.abs(weight).alias("weight"), "scores"), truth), "class"),
    }


def run_training_set(spark: SparkSession, paths: Sequence[str], config: TrainingConfig, target: str) -> DataFrame:
    """From event files to a written training set: the sample comes from the path, rows without an ``event_id`` are known by file and row."""
    events = io.read_events(spark, paths)
    if "event_id" not in events.columns:
        events = events.withColumn("event_id", F.concat_ws(":", "path", F.lpad(F.col("row_index").cast("string"), 12, "0")))
    return write_training_set(events, config, target)
