"""A training corpus from raw documents, in five stages, each on all that the one before kept.

Quality rules drop what fails, near-duplicate groups keep one document each, live credentials are replaced, sources are
mixed to their weights (documents repeat) and the mix is packed into sequences: the result has the token ids of each
piece and its place, and packing.sequences() only puts the pieces of a sequence together. Each stage's rows are written as
Parquet and read again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafspark.llm import mixing, packing, queries, secrets_scan, superminhash, weak_quality
from leafspark.llm.store import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return superminhash.drop_near_duplicates(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_path(), with_ids=True)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", pack)]

#: SQL can't express EM, MinHash and packing on whole tables; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
