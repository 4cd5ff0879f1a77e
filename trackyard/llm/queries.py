"""The queries of the training-data operators over the given tables, and the SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm import crossparse, decontaminate, hostrules, htmltext, linededup, mixing, ngramtrie, oracles, periodic, prefixtrie, sharding, simhash, siteprior, suffixdedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.with_main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngramtrie.with_scores(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_site_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = siteprior.with_posteriors(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "p_doc", "p_host", "p_path", "p_good", "kept")


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.with_verdict(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False).select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words", "rules.base_failed", "rules.kept")


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contamination.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.with_line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "dedup.n_lines", "dedup.n_dropped", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.with_repeats_removed(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"), (F.col("cut.n_removed") > 0).alias("has_repeats"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op11_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.with_prefixes(_table(spark, sf_dir, "conversations"))


def op12_sparse_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c.split('.')[1]}_sha256")
    return found.select("doc_id", *[f"periodic.{c}" for c in ("n_runs", "start", "length", "period", "exponent_milli")], digest("periodic.runs"), digest("periodic.collapsed"))


def op13_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = crossparse.is_held_out("doc_id")
    found = crossparse.with_language(docs, crossparse.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_tree_scoring, op2_ngram_trie, op3_golay_simhash, op4_vector_sharding, op5_site_posteriors,
        op6_host_rules, op7_wu_manber, op8_line_dedup, op9_suffix_array, op10_pareto_mix,
        op11_prefix_forest, op12_sparse_diagonal, op13_cross_parsing,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_host_rules": oracles.OP6, "op8_line_dedup": oracles.OP8, "op10_pareto_mix": oracles.OP10, "op11_prefix_forest": oracles.OP11, "op12_sparse_diagonal": oracles.OP12}
