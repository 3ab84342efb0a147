"""Queries of this subpackage, by name, and the SQL that should give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, chat, decontam, filter_audit, html_text, language, media, near_dup, oracles, packing, quality, secret_scan, sharding, subspace_join


# What SQL can say of the operators' results: the parts that don't rest on a model or on the order of moves.


def language_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op2_language(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == language.UNKNOWN).alias("und"))


def quality_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.op3_quality(spark, sf_dir)
    agrees = F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= quality.THRESHOLD).cast("int"))
    return found.select("doc_id", "held_out", agrees.alias("agrees"))


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.op4_shards(spark, sf_dir).groupBy("shard")
    return placed.agg(F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op4_shards(spark, sf_dir).select("doc_id", "size")


def media_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op5_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op7_secrets(spark, sf_dir).drop("spans")


QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_language": language.op2_language,
    "op3_quality": quality.op3_quality,
    "op4_shards": sharding.op4_shards,
    "op5_media": media.op5_media,
    "op6_near_duplicates": near_dup.op6_near_duplicates,
    "op7_secrets": secret_scan.op7_secrets,
    "op8_packing": packing.op8_packing,
    "op9_main_text": html_text.op9_main_text,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_clusters": ball_kmeans.op11_clusters,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_embedding_links": subspace_join.op13_embedding_links,
    "language_frame": language_frame,
    "quality_frame": quality_frame,
    "shard_balance": shard_balance,
    "shard_sizes": shard_sizes,
    "media_frame": media_frame,
    "secret_base_spans": secret_base_spans,
}
ORACLE_SQL = {
    "op1_chat_format": chat.ORACLE,
    "op6_near_duplicates": oracles.NEAR_DUPLICATES,
    "op11_clusters": ball_kmeans.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_embedding_links": subspace_join.ORACLE,
    "language_frame": oracles.LANGUAGE_FRAME,
    "quality_frame": oracles.QUALITY_FRAME,
    "shard_balance": oracles.SHARD_BALANCE,
    "shard_sizes": oracles.SHARD_SIZES,
    "media_frame": oracles.MEDIA_FRAME,
    "secret_base_spans": oracles.SECRET_BASE,
}
