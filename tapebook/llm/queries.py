"""The operators' queries over the given tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapebook.llm import chat, decontaminate, negatives, packing, piecewise, repetition, resampling, secrets, simhash, tokenstore, toxicity, variants, wrappers


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_read(spark, sf_dir, "documents"))


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(_read(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.report(_read(spark, sf_dir, "documents"))


def op8_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.report(_read(spark, sf_dir, "pages"))


def op9_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.report(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_read(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(_read(spark, sf_dir, "embeddings"))


def op12_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.report(_read(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_resampling": op3_resampling,
    "op4_secrets": op4_secrets,
    "op5_chat": op5_chat,
    "op6_decontaminate": op6_decontaminate,
    "op7_repetition": op7_repetition,
    "op8_wrappers": op8_wrappers,
    "op9_tokenstore": op9_tokenstore,
    "op10_packing": op10_packing,
    "op11_negatives": op11_negatives,
    "op12_piecewise": op12_piecewise,
    "op13_variants": op13_variants,
}

SQL: dict[str, str] = {"op4_secrets": secrets.SQL, "op6_decontaminate": decontaminate.SQL, "op11_negatives": negatives.SQL}
