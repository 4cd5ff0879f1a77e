"""Fixed-width inputs, assignment targets, stacked features and derived scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.functions import columns as C

#: Classes by index of the score vector; index 0 is unused. Fixed values.
CLASSES = {1: "tthbb", 2: "qcd", 3: "ttlf", 4: "ttcc", 5: "ttbb", 6: "singletop", 7: "ttv", 8: "vjets", 9: "tthnonbb"}
#: Truth codes of the daughters of each particle: (daughter, code, which jet of that code). Fixed values.
TARGETS = {"h": (("b1", 1, 0), ("b2", 1, 1)), "t1": (("q1", 5, 0), ("q2", 5, 1), ("b", 2, 0)), "t2": (("q1", 6, 0), ("q2", 6, 1), ("b", 3, 0))}


def sin_cos_phi(df: DataFrame, phi: str = "phi") -> DataFrame:
    return df.withColumns({"sin_phi": F.transform(phi, lambda x: F.sin(x)), "cos_phi": F.transform(phi, lambda x: F.cos(x))})


def is_electron(pdg_id: Column) -> Column:
    return (F.abs(pdg_id) == 11).cast("int")


def event_ht(df: DataFrame, jets: str = "jets", out: str = "ht") -> DataFrame:
    """Sum of pt over all jets of the event, not only those kept."""
    return df.withColumn(out, C.total(F.col(f"{jets}.pt")))


def object_features(df: DataFrame, inputs: Mapping[str, Sequence[str]], n: int = 16, jets: str = "jets") -> DataFrame:
    """``inputs`` as struct columns: padded arrays of the jet's features with MASK, scalars of single objects and of the event.

    A jet collection without MASK, MASK without pt and a collection that the table lacks are errors.
    """
    made = []
    for obj, features in inputs.items():
        if obj == "Jet":
            if "MASK" not in features:
                raise ValueError("the Jet inputs must include MASK")
            if "pt" not in features:
                raise ValueError("MASK needs pt among the features")
            one = {"sin_phi": lambda: F.transform(f"{jets}.phi", lambda x: F.sin(x)), "cos_phi": lambda: F.transform(f"{jets}.phi", lambda x: F.cos(x))}
            columns = [C.mask_from_pt(C.pad_clip(F.col(f"{jets}.pt"), n, 0.0)).alias(f) if f == "MASK" else C.pad_clip((one[f]() if f in one else F.col(f"{jets}.{f}")).cast("array<double>"), n, 0.0).cast("array<float>").alias(f) for f in features]
        elif obj == "Event":
            columns = [(C.total(F.col(f"{jets}.pt")) if f == "ht" else F.col(f"events.{f}")).cast("float").alias(f) for f in features]
        else:
            if obj not in df.columns:
                raise ValueError(f"no collection {obj}")
            one = {"sin_phi": lambda o=obj: F.sin(f"{o}.phi"), "cos_phi": lambda o=obj: F.cos(f"{o}.phi"), "is_electron": lambda o=obj: is_electron(F.col(f"{o}.pdgId"))}
            columns = [(one[f]() if f in one else F.col(f"{obj}.{f}")).cast("float").alias(f) for f in features]
        made.append(F.struct(*columns).alias(obj))
    return df.withColumn("inputs", F.struct(*made))


def assign_targets(df: DataFrame, n: int = 16, prov: str = "jets.prov", targets: Sequence[str] = ("h", "t1", "t2")) -> DataFrame:
    """``targets.<particle>.<daughter>``: index of the jet of the daughter's truth code; -1 if missing or ``n`` and above."""
    made = []
    for p in targets:
        if p not in TARGETS:
            raise ValueError(f"no particle {p}")
        made.append(F.struct(*[C.cap_index(C.index_of(F.col(prov), code, nth), n).alias(d) for d, code, nth in TARGETS[p]]).alias(p))
    return df.withColumn("targets", F.struct(*made))


def unlabelled_targets(df: DataFrame, targets: Sequence[str] = ("h", "t1", "t2")) -> DataFrame:
    """All targets -1, for events without truth."""
    return df.withColumn("targets", F.struct(*[F.struct(*[F.lit(-1).cast("long").alias(d) for d, _, _ in TARGETS[p]]).alias(p) for p in targets]))


def classification_columns(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``classifications.event.<label>`` as long; a missing label is an error."""
    if missing := set(labels) - set(df.columns):
        raise ValueError(f"no label {sorted(missing)}")
    return df.withColumn("classifications", F.struct(F.struct(*[F.col(x).cast("long").alias(x) for x in labels]).alias("event")))


def training_row(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Key, columns to ``keep``, inputs, targets, classifications and ``weights.weight`` (float) of each event."""
    return df.select("event_id", *keep, "inputs", "targets", "classifications", F.struct(F.col("weight").cast("float").alias("weight")).alias("weights"))


def _stacked(arrays: Sequence[Column]) -> Column:
    return F.transform(arrays[0], lambda x, i: F.array(*[F.get(a, i) for a in arrays]))


def _item(vectors: str, k: int) -> Column:
    return F.transform(vectors, lambda v: F.get(v, F.lit(k)))


def _log_items(vectors: str, kinds: Sequence[str]) -> Column:
    item = lambda v, k, kind: F.log1p(F.get(v, F.lit(k))).cast("float") if kind == "log_normalize" else F.get(v, F.lit(k))
    return F.transform(vectors, lambda v: F.array(*[item(v, k, kind) for k, kind in enumerate(kinds)]))


def stack_features(df: DataFrame, sequential: Mapping[str, Sequence[str]], singles: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per-object vectors in the order of the config: ``<group>_data`` and ``<group>_mask``; single groups have one vector and a true mask."""
    out = {}
    for group, features in sequential.items():
        arrays = [F.col(f"inputs.{group}.{f}") for f in features]
        out[f"{group}_data"] = _stacked(arrays)
        out[f"{group}_mask"] = F.col(f"inputs.{group}.MASK")
    for group, features in singles.items():
        out[f"{group}_data"] = F.array(F.array(*[F.col(f"inputs.{group}.{f}") for f in features]))
        out[f"{group}_mask"] = F.array(F.lit(True))
    return df.withColumns(out)


def log_normalize(df: DataFrame, transforms: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """log1p of the features whose transform is ``log_normalize``, made in double and rounded to float as all vectors are; others stay as they are."""
    return df.withColumns({f"{group}_data": _log_items(f"{group}_data", list(features.values())) for group, features in transforms.items()})


def unstack_features(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Vectors back to one array for each feature."""
    return df.withColumns({f"{group}_{f}": _item(f"{group}_data", k) for k, f in enumerate(features)})


def node_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    """A named column for each class score."""
    return df.withColumns({name: F.get(F.col(scores), F.lit(k)) for k, name in CLASSES.items()})


def derived_scores(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """tthbb against ttbb, against ttbb and qcd, and against those with ttlf and ttcc; and against ttbb without ``eps``, null where both are 0."""
    h, b, q = F.col("tthbb"), F.col("ttbb"), F.col("qcd")
    return df.withColumns(
        {
            "tthbb_vs_ttbb": h / (h + b + F.lit(eps)),
            "tthbb_vs_qcd_ttbb": h / (h + b + q + F.lit(eps)),
            "tthbb_vs_qcd_ttbar": h / (h + b + q + F.col("ttlf") + F.col("ttcc") + F.lit(eps)),
            "tthbb_vs_ttbb_plain": F.try_divide(h, h + b),
        }
    )


def truth_prediction(df: DataFrame, truth: str = "signal") -> DataFrame:
    """A row for each event and class: whether it is the true class, and the class's score."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col(truth) == k).alias("is_true"), F.get(F.col("scores"), F.lit(k)).alias("score")) for k in CLASSES]))
    return df.withColumn("__row", rows).select(*df.columns, "__row.*")


def binary_heads(df: DataFrame, heads: Mapping[str, str]) -> DataFrame:
    """The same from separate binary classifiers: the score is column 1 of the head, the truth its own 0/1 label."""
    rows = F.explode(F.array(*[F.struct(F.lit(head).alias("class"), (F.col(label) == 1).alias("is_true"), F.get(F.col(head), F.lit(1)).alias("score")) for head, label in heads.items()]))
    return df.withColumn("__row", rows).select("event_id", "__row.*")
