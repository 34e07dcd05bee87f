"""The registered queries over the corpus tables, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm import bpe, chat, decontam, digest, exactdedup, langid, licenses, packing, prefixtrie, resample, secrets, simhash, topk
from cartolake.llm.common import saved


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest.compare(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", F.base64("fingerprint").alias("fingerprint"), F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


def op3_bond_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PROBE).alias("text"))
    return chat.digests(chat.segments(chat.messages(chat.log_of(rows.union(probe)))), chat.in_turn())


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    counts = [secrets.count_of("base", k).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("spans").alias("spans"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = saved(prefixtrie.sequences(_read(spark, sf_dir, "conversations")), "conversations")
    found = prefixtrie.trie(prefixtrie.with_shared_starts(convs))
    return found.select(F.col("id").alias("conv_id"), "depth", F.col("parent_id").alias("parent_conv_id"), F.col("n_members").alias("n_convs"), "n_children", "n_leaves", F.col("saved_words").alias("saved_tokens"), "ends_sha256")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_QUERIES = (op1_license_scan, op2_improbable_digest, op3_bond_top_k, op4_bpe_round_trip, op5_language_id, op6_chat_format, op7_best_fit_packing, op8_simhash_near_dedup, op9_suffix_dedup, op10_secret_scan, op11_importance_resample, op12_prefix_trie, op13_decontaminate)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*_QUERIES, pipeline)}


def oracle_sql() -> dict[str, str]:
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return piped | {"op1_license_scan": licenses.oracle(), "op3_bond_top_k": topk.oracle(), "op9_suffix_dedup": exactdedup.oracle(), "op6_chat_format": chat.oracle(), "op11_importance_resample": resample.oracle(), "op12_prefix_trie": prefixtrie.oracle(), "op13_decontaminate": decontam.oracle()}
