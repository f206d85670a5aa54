"""The queries of this package's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from larkspur.llm import cotrain, lempelziv, linededup, media, mixing, pieces, simhash, suffixes, tokstore, topk
from larkspur.llm.common import documents


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_substrings(documents(spark, sf_dir)).drop("kept_text")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(embeddings, embeddings.where("vec_id % 50 = 0"), 5)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.remove_passages(documents(spark, sf_dir)).drop("kept_text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir)).drop("kept_text")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokstore.write_store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return tokstore.read_digests(store)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_mix_sources": op4_mix_sources,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_store": op8_token_store,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_media_columns": op10_media_columns,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": suffixes.REMOVE_SUBSTRINGS_SQL,
    "op3_exact_top_k": topk.TOP_K_SQL,
    "op6_substring_dedup": lempelziv.REMOVE_PASSAGES_SQL,
}
