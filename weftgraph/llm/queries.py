"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balanced_sharding, circulant_minhash, common, cube_mixing, deleted_interpolation, ffd_packing, golomb_dedup, knn_quality, spotsigs, subword_langid, token_output


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.against_next(_documents(spark, sf_dir))


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = knn_quality.fit(docs, labels.where(common.crc_mod("doc_id", 4) != 2))
    scored = knn_quality.score(docs, model)
    return scored.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = subword_langid.fit(docs.where(common.crc_mod("doc_id", 5) != 0))
    return subword_langid.predict(docs, model).select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(_documents(spark, sf_dir), words=3, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golomb_dedup.dedup(_documents(spark, sf_dir))


def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies")


def op8_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_sharding.shard(_documents(spark, sf_dir), shards=40)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_tokens(_documents(spark, sf_dir), token_output.scratch_path(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.checksums(token_output.read_tokens(spark, path))


def op10_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_spotsigs, op2_knn_quality, op3_subword_langid, op4_packing, op5_circulant_minhash, op6_exact_dedup, op7_cube_mixing, op8_balanced_sharding, op9_token_output, op10_deleted_interpolation)}

ORACLE_SQL = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
