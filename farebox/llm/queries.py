"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from farebox.llm import alignment, chat, decontaminate, graph, licenses, periodic, pieces, quality, simhash, toxicity, unigram, urls, warc
from farebox.llm.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]
Query = Callable[[SparkSession, str], DataFrame]
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))  # vocabulary files are read by the driver only
BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), PIECES)


def op10_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents"), periodic.planted)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), BYTES, PIECES)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_licenses": op8_licenses,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_embedding_graph": op10_embedding_graph,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filter": op12_url_filter,
    "op13_token_alignment": op13_token_alignment,
}
