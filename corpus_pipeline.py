"""The corpus pipeline: language ID, near-duplicates, secrets, packing.

Each stage is written as Parquet and read again by the next; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, langid, packing, queries, secrets, simhash
from rasterloom.llm.common import bound_batches, delete, shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled part of them teaches."""
    bound_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by the kind of secret."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    bound_batches(spark)
    return packing.digest(packing.pack(docs, bpe.vocabulary(queries.tokenizer_path())))


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("secret_scan", secret_scan), ("packing", pack)]
#: Fingerprints, filters and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that remain of documents after all stages.

    Null and empty texts are in no language, so the first stage drops them; rows with a null id
    stay; an empty table gives an empty result. A stage's table is deleted once the next one is
    written. Queries set the session's Arrow batches, see :func:`rasterloom.llm.common.bound_batches`.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
