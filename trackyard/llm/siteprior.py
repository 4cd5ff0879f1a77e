"""Operator 5: a quality classifier whose document evidence is pooled with its site's, by hierarchical empirical Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch

#: Most labelled rows that the document classifier is fitted on.
LABELLED = 20_000
SYMBOLS = b"#*$%&|<>!"


def _level(share: float) -> int:
    """A share on a scale of 0 (none) to 6 (nearly all)."""
    return 0 if share <= 0 else min(6, 1 + int(share * 20)) if share < 0.25 else 6


def features(text: bytes | None) -> set[bytes]:
    """Distinct words, A-Z lower-cased, and marks of shape: symbols, repeated words and lines, lengths. Whole texts are read."""
    text = (text or b"").lower()
    words = text.split()
    found = set(words)
    n = len(words)
    kept = text.translate(None, SYMBOLS)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    alone = sum(w.translate(None, SYMBOLS) == b"" for w in words)
    found.update(
        (
            b"\x00symbols%d" % _level((len(text) - len(kept)) / max(1, len(text) - n) * 2),
            b"\x00alone%d" % _level(alone / max(1, n)),
            b"\x00again%d" % _level(again / max(1, n)),
            b"\x00lines%d" % _level(1 - len(set(lines)) / max(1, len(lines))),
            b"\x00length%d" % min(16, n.bit_length()),
            b"\x00word%d" % min(20, len(kept) // max(1, n)),
            b"\x00line%d" % min(12, (n // max(1, len(lines))).bit_length()),
        )
    )
    return found


def _present(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (text, good): how many good and bad texts of a task have each feature."""
    counts: dict[bytes, list[int]] = {}
    for part in parts:
        for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for x in features(text):
                counts.setdefault(x, [0, 0])[good] += 1
    names = list(counts)
    for k in range(0, len(names), 50_000):
        own = names[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([counts[x][1] for x in own], pa.int64()), pa.array([counts[x][0] for x in own], pa.int64())], names=["feature", "good", "bad"])


def _scorer(weights: dict[bytes, float], base: float, spark) -> Column:
    sent = spark.sparkContext.broadcast(weights)

    def score(texts: pd.Series) -> pd.Series:
        own = sent.value
        return pd.Series([base + math.fsum(own[x] for x in sorted(features(t) & own.keys())) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")


class Model:
    """log odds of a good document: a linear function of the features it has."""

    def __init__(self, weights: dict[bytes, float], base: float):
        self.weights, self.base = weights, base

    def log_odds(self, text: Column, spark) -> Column:
        return _scorer(self.weights, self.base, spark)(text.cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LABELLED, z: float = 4.0, penalty: float = 3e-4) -> Model:
    """Fit on up to ``limit`` labelled rows, those of the least hashes of id and text: good is quality 1 and not toxic.

    ``labels`` (doc_id, quality, toxic): rows without id or quality are left out, a null toxic is 0; where labels of one id differ, it is bad.
    Rows equal in id and text are one; an id with many texts is as many rows, and they count against the bound as others do. Numbers alone are ranked; the texts of the chosen rows are read after that.
    A feature is used if the shares of good and bad texts that have it differ by ``z`` standard errors, for which at least some z squared of the labelled texts must have it;
    a logistic regression with an L1 penalty weighs them. Counts are sums over tasks; what comes to the driver, the names of such features, is bounded by the
    words of the labelled texts over z squared. Without both classes, all documents are good.
    """
    spark = docs.sparkSession
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.min(good).alias("__good"))
    texts = docs.select(F.col(id_col).alias("__lid"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h"))
    marks = texts.select("__lid", "__h").join(known, "__lid").distinct()
    chosen = marks.orderBy(F.xxhash64("__lid", "__h"), "__lid", "__h").limit(limit)
    # At most `limit` rows, and as many texts.
    rows = texts.join(F.broadcast(chosen), ["__lid", "__h"]).groupBy("__lid", "__h").agg(F.first("text").alias("text"), F.first("__good").alias("good")).select("text", "good")
    rows = scratch.save(rows, "quality-sample")
    n = rows.agg(F.count("*").alias("n"), F.sum("good").alias("g")).first()
    g, b = float(n["g"] or 0), float(n["n"] - (n["g"] or 0))
    if not g or not b:
        return Model({}, 6.0)
    counts = rows.mapInArrow(_present, "feature binary, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    share = (F.col("good") + F.col("bad")) / (g + b)
    error = F.sqrt(share * (1 - share) * (1 / g + 1 / b))
    tells = F.abs(F.col("good") / g - F.col("bad") / b) / error
    top = counts.where(share < 1).withColumn("tells", tells).where(F.col("tells") >= z).select("feature").collect()
    names = sorted(bytes(r["feature"]) for r in top)
    if not names:
        return Model({}, math.log(g / b))
    sent = spark.sparkContext.broadcast({x: k for k, x in enumerate(names)})

    def present(texts: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([sorted(str(known[x]) for x in features(t) & known.keys()) for t in texts])

    wide = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(names))], inputCol="names", outputCol="features")
    wide.setBinary(True)
    points = wide.transform(scratch.save(rows.select(F.pandas_udf(present, "array<string>")("text").alias("names"), F.col("good").cast("double").alias("label")), "quality-points"))
    found = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(points.coalesce(6))
    weights = {x: float(w) for x, w in zip(names, found.coefficients.toArray(), strict=True) if w}
    return Model(weights, float(found.intercept))


def _odds(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def _strength(groups: DataFrame, mean: Column, n: Column, k: Column) -> Column:
    """Prior strength of a level by the method of moments: between-group variance of rates beyond binomial noise, held within 1 and 1000."""
    noise = F.sum(mean * (1 - mean))
    spread = F.sum(n * (k / n - mean) * (k / n - mean))
    between = (spread - noise) / F.sum(n)
    typical = noise / F.count("*")
    return F.when(between > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), typical / between - 1))).otherwise(F.lit(1000.0))


def with_posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, p_doc, p_host, p_path, p_good, kept) for each row of ``docs``.

    p_doc comes from the document alone. Sums of p_doc by host and by (host, path) give posteriors: a host's mean shrinks towards the
    mean of all, a path's mean towards its host's, each with a strength estimated from the spread of its level, so sparse sites stay near
    the prior. A document's own share is taken out of its path before its log odds and its path's, relative to the mean of all, add up to p_good.

    Texts are read once for the score, kept as a table of numbers; sums are made map-side, so a hot host is no hot task. Null hosts and paths are
    groups of their own. Null texts are texts without words. Repeated rows are scored each and count each; without labels all is kept. An empty table gives an empty one; extra
    columns of any name are not looked at. A p_good that meets the threshold is kept.
    """
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    model = fit(docs, labels, id_col, text)
    odds = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), model.log_odds(F.col(text), spark)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), odds.alias("odds"))
    rows = scratch.save(rows.withColumn("p_doc", 1 / (1 + F.exp(-F.col("odds")))), "quality-rows")
    # Written once: all levels and priors are made from these sums.
    paths = scratch.save(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p_doc").alias("k")), "quality-paths")
    hosts = paths.groupBy(F.col("host").alias("h_host")).agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    mean = hosts.agg((F.sum("hk") / F.sum("hn")).alias("mean"))
    # Tables of one row: the levels' priors.
    top = hosts.crossJoin(F.broadcast(mean))
    strength = top.agg(_strength(top, F.col("mean"), F.col("hn"), F.col("hk")).alias("host_strength"))
    top = top.crossJoin(F.broadcast(strength))
    top = scratch.save(top.withColumn("p_host", (F.col("hk") + F.col("host_strength") * F.col("mean")) / (F.col("hn") + F.col("host_strength"))), "quality-hosts")
    low = scratch.save(paths.join(top.select("h_host", "p_host", "mean"), F.col("host").eqNullSafe(F.col("h_host"))), "quality-levels")
    low = low.crossJoin(F.broadcast(low.agg(_strength(low, F.col("p_host"), F.col("n"), F.col("k")).alias("path_strength"))))
    site = low.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "k", "p_host", "mean", "path_strength")
    site = scratch.lookup(site, "quality-sites")
    joined = rows.join(site, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    others = (F.col("k") - F.col("p_doc") + F.col("path_strength") * F.col("p_host")) / (F.col("n") - 1 + F.col("path_strength"))
    others = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), others))
    center = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("mean")))
    total = F.col("odds") + _odds(others) - _odds(center)
    found = joined.withColumn("p_path", others).withColumn("p_good", 1 / (1 + F.exp(-total)))
    return found.select("id", "host", "path", "p_doc", "p_host", "p_path", "p_good", (F.col("p_good") >= threshold).alias("kept"))
