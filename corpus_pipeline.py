"""The training-data pipeline: each stage applies one operator to what the one before kept.

Stages take and return the columns of ``documents``; the last returns the encoded documents.
No stage can be expressed in SQL as a whole (a trained scorer, set similarity components and
a tokenizer), so ``ORACLE_SQL`` is None and the tests use a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchloom.llm import common, lsh_forest, mixing, sentencepiece_codec, substring_dedup, toxic_passages


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    common.bound_batches(spark)
    model = toxic_passages.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_passages.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    common.bound_batches(spark)
    return lsh_forest.drop_near_duplicates(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that repeat in the corpus go; every document stays with the rest."""
    common.bound_batches(spark)
    return substring_dedup.strip_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix of sources takes it: never, once or twice."""
    common.bound_batches(spark)
    return mixing.repeat_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and ids_crc32 of every document."""
    common.bound_batches(spark)
    return sentencepiece_codec.encode_documents(docs).select("doc_id", "ids", "n_pieces", "ids_crc32")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring), ("mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
