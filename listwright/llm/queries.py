"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bloom_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_urls import filtered

    # the list stands for one of hosts: those whose digest begins with 0
    return filtered(table(spark, sf_dir, "pages"), F.substring(F.md5(F.col("host").cast("binary")), 1, 1) == "0")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_licences import licences

    return licences(table(spark, sf_dir, "documents"))


def op4_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op5_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_anisotropic import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_language import languages

    return languages(table(spark, sf_dir, "documents"))


def op8_bootstrapped_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_personal import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_minmax import classes

    return classes(table(spark, sf_dir, "documents"), width=2, percent=80).drop("root", "h")


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_backoff import scores

    # sums of logarithms differ in their last digits with the order they are added in
    return scores(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("log10_score", "mean_log10")})


def op13_digest_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_exact_dedup import copies

    return copies(table(spark, sf_dir, "documents"))


def op11_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_funnels import funnel_counts

    return funnel_counts(table(spark, sf_dir, "clicks"))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_bloom_cascade_url_filter": oracles.OP2,
        "op4_flow_mixing": oracles.OP4,
        "op5_anisotropic_neighbours": oracles.OP5,
        "op9_minmax_near_dedup": oracles.OP9,
        "op10_stupid_backoff": oracles.OP10,
        "op11_ordered_funnels": oracles.OP11,
        "op13_digest_tree_dedup": oracles.OP13,
    }
