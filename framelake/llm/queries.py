"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, exact_dedup, fingerprints, langid, mixing, neardup, packing, quality, sharding, suffix_dedup, token_counts, trie
from .common import documents, fold, scratch


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    weights = quality.trained(docs, labels)
    held = docs.select("doc_id", (fold(5) == 0).alias("held_out"), "text")
    return quality.scored(held, weights, threshold=0.3).drop("text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measured(documents(spark, sf_dir).select("doc_id", "text"), length=100)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(items)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir).select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(documents(spark, sf_dir).select("doc_id", "text"), k=2, percent=80)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = token_counts.counted(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold(4) == 2).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predicted(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_mixing, op3_suffix_dedup, op4_best_fit_packing, op5_fingerprints, op6_sharding, op7_near_duplicates, op8_token_counts, op9_language_id, op10_nearest_neighbours, op11_vector_codes, op12_exact_dedup, op13_conversation_trie)
}

ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE_SQL, "op6_sharding": sharding.ORACLE_SQL, "op11_vector_codes": codes.ORACLE_SQL, "op12_exact_dedup": exact_dedup.ORACLE_SQL, "op13_conversation_trie": trie.ORACLE_SQL}
