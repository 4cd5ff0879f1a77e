"""A corpus pipeline over ``documents``: rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm import decontaminate, hostrules, mixing, scratch, sharding, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    return hostrules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity 0.8 or more of five-word shingles."""
    return simhash.one_of_each(docs, size=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix."""
    placed = sharding.assign(docs)
    return placed.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: XXH64 fingerprints have no equivalent in DuckDB SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over ``docs``, each written and read again; what a stage wrote for itself, and its input, go once its rows are written.

    An empty table gives an empty one. Null and empty texts, as all of under 50 words, go in the first stage. Rows with equal texts, whatever their ids, come down to one in the
    second. A null source is a source of its own. Extra columns pass through to the last stage, whose columns are its own; names that begin with __ are for the stages.
    """
    since = scratch.mark()
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop_since(spark, since, docs)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    return apply(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
