"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import chat, embed_dedup, langid, mixing, packing, secrets_scan, sharding, substring_dedup, superminhash, weak_quality
from .oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, spread=name == "documents")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeated_spans(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.minhash_groups(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24, overhead=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.repetition_plan(_table(spark, sf_dir, "documents"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_quality.score_quality(_table(spark, sf_dir, "documents"), ["doc_id"])
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.withColumn("piece", F.col("piece").cast("int"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :hard), (-7L, 1L, 'assistant', :hard) AS t (conv_id, turn, role, text)", args={"hard": hard})
    return chat.digests(chat.format_examples(said.unionByName(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1,
        "op2_minhash_near_dedup": op2,
        "op3_sharding": op3,
        "op4_source_mixing": op4,
        "op5_secret_scan": op5,
        "op6_embedding_near_dedup": op6,
        "op7_quality_rules": op7,
        "op8_best_fit_packing": op8,
        "op9_language_id": op9,
        "op10_chat_format": op10,
    }
