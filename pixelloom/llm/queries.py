"""The registered queries of the operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, knn, language, lm, oracle, packing, pii, quality, toxicity, transducer, vocabulary, wordbpe

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(documents(spark, sf_dir))


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op3_shape_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op4_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(documents(spark, sf_dir), vocabulary.public_path(BYTE_BPE))


def op5_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary.public_path(BYTE_BPE))


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_contiguous_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(documents(spark, sf_dir), vocabulary.public_path(WORD_BPE))


def op9_universe_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(documents(spark, sf_dir))


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_voronoi_join": oracle.TOP_PRODUCTS, "op9_universe_partition_join": oracle.JACCARD}
