"""A training-corpus pipeline: quality filter, exact dedup, near dedup, mixing, packing.

Defined cases, for every stage but where it says otherwise: null texts count as empty; repeated rows are rows; ties go by the rows'
columns, never by their place; an empty table gives an empty one; all columns of the input are kept, whatever their names.

Stages but the first begin by having the executors hand back the memory that the stage before needed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import circulant_minhash, common, cube_mixing, ffd_packing, golomb_dedup, knn_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Labels of a quarter of the ids are never learnt from, as in op2.

    Without labelled documents every score is 0.5, below the threshold, so all go; empty texts are scored like any other.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = labels.where(common.crc_mod("doc_id", 4) != 2)
    return knn_quality.keep(docs, knn_quality.fit(docs, learn))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; one without an id only where no copy has one."""
    common.compact(spark)
    return golomb_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 over five-word shingles the one with the smallest id stays; texts without words all stay."""
    common.compact(spark)
    return circulant_minhash.keep_one(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice (two rows with one id). A null source is one of its own."""
    common.compact(spark)
    return cube_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; copies that the mix took have the same doc_id and start."""
    common.compact(spark)
    return ffd_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), most_bytes=1 << 20)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
