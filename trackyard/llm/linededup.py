"""Operator 8: lines that many documents share are dropped, except in one document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch

#: Documents that hold a line from which on it is hot, at least; no more lines are hot than a lookup table may have rows.
HOT = 100_000
#: ASCII white space: what is stripped from a line's ends.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Texts without the lines whose key has one of the hashes; None where there is no text."""
    space, lower = SPACE.encode(), bytes.maketrans(UPPER.encode(), LOWER.encode())
    for texts, hashes in parts:
        rows = []
        for text, lost in zip(texts, hashes, strict=True):
            if text is None:
                rows.append((None, 0))
                continue
            gone, all_lines = set(map(bytes, lost)), text.split(b"\n")
            kept = [x for x in all_lines if hashlib.md5(x.strip(space).translate(lower)).digest() not in gone]
            rows.append((b"\n".join(kept).decode("utf-8", "replace"), len(all_lines) - len(kept)))
        yield pd.DataFrame(rows, columns=["kept", "n"])


def with_line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "dedup", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with a struct column ``out``: n_lines, n_dropped, kept (the text that stays).

    Keys of at least ``min_chars`` code points held by at least ``min_docs`` different ids lose all their lines but those in
    the largest id that holds them. A line is compared by the 128-bit MD5 of its key. Only (hash, id) pairs are shuffled to count,
    first by both, so that a line found everywhere is spread, then by hash with map-side sums. Hashes of :data:`HOT` documents and more, or of a 50,000th of all pairs if that is more, are sent to the pairs, which stay where they
    are; other hashes meet theirs by a shuffle. Texts are shuffled once, to meet the hashes that their document loses; those that lose lines are rebuilt in order with one look into a set for each line, so the work is
    linear in the lines of a document.

    Rows that share an id are one document when documents are counted, and each loses the same keys. A null id is one document below
    all others. Null and empty texts have one empty line and lose nothing. Extra columns pass through; an existing column ``out`` is replaced.
    """
    scratch.bound_batches(docs.sparkSession)
    docs = docs.drop(out)
    long_keys = F.filter(F.transform(lines(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars)
    held = (
        docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(long_keys, lambda k: F.unhex(F.md5(k))))).alias("h"))
        .distinct()
    )
    common = held.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    common = scratch.save(common, "line-common")
    pairs = common.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(HOT, pairs // 50_000)
    by_hot = F.broadcast(common.where(hot).select("h", F.lit(True).alias("hot"), F.col("keeper").alias("hot_keeper")))
    split = held.join(by_hot, "h", "left")
    near = split.where("hot").select("id", "h", F.col("hot_keeper").alias("keeper"))
    far = split.where("hot IS NULL").select("id", "h").join(common.where(~hot).select("h", "keeper"), "h").select("id", "h", "keeper")
    lost = (
        near.unionByName(far).where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id").agg(F.collect_set("h").alias("__lost")).withColumnRenamed("id", "__id")
    )
    all_lines, loses = lines(F.col(text)), F.col("__lost").isNotNull()
    joined = docs.join(lost, docs[id_col].eqNullSafe(F.col("__id")), "left")
    rebuilt = F.pandas_udf(_without, "kept string, n long")(F.when(loses, F.col(text).cast("binary")), F.col("__lost"))
    joined = joined.withColumn("__kept", rebuilt)
    return joined.withColumn(
        out,
        F.struct(
            F.size(all_lines).cast("long").alias("n_lines"),
            F.col("__kept.n").alias("n_dropped"),
            F.coalesce("__kept.kept", text, F.lit("")).alias("kept"),
        ),
    ).drop("__lost", "__id", "__kept")


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """Documents with the lines that stay as their text; ``n_chars`` follows where the table has it."""
    mark = "__dedup"
    text = options.get("text", "text")
    found = with_line_dedup(docs, out=mark, **options).withColumn(text, F.col(mark)["kept"]).drop(mark)
    return found.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in docs.columns else found
