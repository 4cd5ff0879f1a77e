"""Operator 6: quality rules on documents, pooled into verdicts on their hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch

SPACE = " \t\n\x0b\f\r"
#: Java patterns of ASCII white space and of the characters counted as symbols.
BLANK, SYMBOL = r"[ \t-\r]", r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash within the one text. Only texts with an equal pair sort their (hash, start) pairs.
    """

    def starts(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            pairs,
            lambda s: F.sort_array(F.transform(
                F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))),
                lambda x: x["i"],
            )),
        )

    def covered(at: Column) -> Column:
        width = F.transform(at, lambda v, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - v, F.lit(size))))
        return F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        n = F.size(w) - (size - 1)
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        with_pair = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(starts(h), covered)).otherwise(F.lit(0).cast("long"))
        return F.when(n >= 2, _let(hashes, with_pair)).otherwise(F.lit(0).cast("long"))

    return _let(words, count)


def with_metrics(docs: DataFrame, text: str = "text", out: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have zero counts and fail (under 50 words). An existing column ``out`` is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    n_words = F.regexp_count(body, F.lit(r"[^ \t-\r]+")).cast("long")
    metrics = F.struct(
        n_words.alias("n_words"),
        (F.char_length(body) - F.regexp_count(body, F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(word_array(body)).alias("n_repeat_words"),
    )
    m = F.col(out)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return docs.withColumn(out, metrics).withColumn(out, m.withField("base_failed", failed))


def host_verdicts(scored: DataFrame, host: str = "source", rules: str = "rules", max_rate: float = 0.5) -> DataFrame:
    """Per host: n_docs, n_failed, shrunk failure rate and ``host_ok``.

    A document fails if a base rule fails, if symbols are over a tenth of its word characters, or if its repeated
    lines number over a tenth of its words. The rate of a host is shrunk towards an
    empirical beta prior whose mean and strength come from all hosts by the method of moments: mean m of the pooled rate,
    strength m(1-m)/v - 1 from the variance v of host rates beyond binomial noise, held within 1 and 1000.
    A host is rejected if its shrunk rate is over ``max_rate``. A null host is a host of its own.
    """
    r = F.col(rules)
    failed = r["base_failed"] | (10 * r["n_symbols"] > r["word_chars"]) | (10 * r["n_dup_lines"] > r["n_words"])
    hosts = scored.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    n, k = F.sum("n_docs").cast("double"), F.sum("n_failed").cast("double")
    moments = hosts.agg(
        (k / n).alias("m"),
        F.count("*").cast("double").alias("h"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("sq"),
        n.alias("n"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
    )
    # Between-host variance: the weighted sum of squares beyond its binomial expectation.
    m = F.col("m")
    noise = m * (1 - m)
    between = (F.col("sq") - F.col("n") * m * m - (F.col("h") - 1) * noise) / (F.col("n") - F.col("nn") / F.col("n"))
    strength = F.when((F.col("h") > 1) & (between > 0), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), noise / between - 1))).otherwise(F.lit(1000.0))
    prior = moments.select(m.alias("prior_mean"), strength.alias("prior_strength"))
    rate = (F.col("n_failed") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("n_docs") + F.col("prior_strength"))
    # One row of prior for a table of hosts.
    return hosts.crossJoin(F.broadcast(prior)).withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= max_rate)


def with_verdict(docs: DataFrame, host: str = "source", text: str = "text", out: str = "rules", max_rate: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with the struct of :func:`with_metrics` plus ``host_rate`` and ``kept``.

    ``kept`` is false where a base rule failed, else the verdict on the host. Metrics are computed once and kept as a table in the shared
    folder; only (host, counts) rows are shuffled to pool them, with map-side sums, so a hot host is no hot task. The
    verdicts are joined back by host: sent to all tasks while they are few, else Spark splits a skewed host.
    Without ``keep_text`` the text is left out of that table and of the result.
    """
    measured = with_metrics(docs, text, out)
    scored = scratch.save(measured if keep_text else measured.drop(text), "hostrules")
    verdict = host_verdicts(scored, host, out, max_rate).select(F.col("host").alias("__host"), F.col("rate").alias("__rate"), F.col("host_ok").alias("__ok"))
    verdict = scratch.lookup(verdict, "hostrules-hosts")
    m = F.col(out)
    joined = scored.join(verdict, F.col(host).eqNullSafe(F.col("__host")), "left")
    return joined.withColumn(out, m.withField("host_rate", F.col("__rate")).withField("kept", ~m["base_failed"] & F.col("__ok"))).drop("__host", "__rate", "__ok")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Documents that pass the base rules and whose host passes, with their own columns."""
    mark = "__rules"
    return with_verdict(docs, out=mark, **options).where(F.col(mark)["kept"]).drop(mark)
