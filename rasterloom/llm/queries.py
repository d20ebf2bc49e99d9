"""Queries of the training-data operators, over whole tables, with production parameters.

Each states nulls, empty tables, repeated rows and extra columns where its operator does; the
queries add columns of digests only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html, langid, packing, secrets, simhash, tokens, topk, urls
from .common import bound_batches, shared_path

#: Where the public vocabularies lie; a parameter of the operators that tokenize.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), ledger_path=shared_path(spark, "secret-ledger"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition, folder = bpe.vocabulary(tokenizer_path()), shared_path(spark, "tokens")
    written = tokens.write_tokens(table(spark, sf_dir, "documents"), definition, folder)
    return tokens.document_tokens(tokens.count_tokens(spark, folder, tokens.end_of(definition), tokens.width(definition)), written)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary(tokenizer_path())))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = bpe.vocabulary(tokenizer_path())
    both = bpe.round_trip(table(spark, sf_dir, "documents"), definition)
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_html_main_text,
        op3_simhash_near_dedup,
        op4_exact_top_k,
        op5_token_counts,
        op6_packing,
        op7_bpe_round_trip,
        op8_url_filter,
        op9_language_id,
        op10_embedding_near_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secrets.SCAN_SQL,
    "op4_exact_top_k": topk.SQL,
    "op8_url_filter": urls.judge_sql(),
    "op10_embedding_near_dedup": embedding_dedup.SQL,
}
