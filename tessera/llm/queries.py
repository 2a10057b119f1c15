"""The numbered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, feistel_shards, fill_middle, fixity, html_text, licenses, line_crf, merge_dropout, secrets_scan, simhash, token_counts, topk_search, whitening
from .common import table


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.op1_merge_dropout(table(spark, sf_dir, "documents"))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.op2_randomness_battery(table(spark, sf_dir, "documents"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op3_site_templates(table(spark, sf_dir, "pages"))


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4_golay_simhash(table(spark, sf_dir, "documents"))


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.op5_line_crf_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.op6_block_max_wand(table(spark, sf_dir, "documents"))


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.op7_merkle_fixity(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op8_token_counts(table(spark, sf_dir, "documents"))


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op9_license_templates(table(spark, sf_dir, "documents"))


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_benchmark_containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.op11_feistel_shards(table(spark, sf_dir, "documents"))


def op12_relational_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.op12_relational_units(table(spark, sf_dir, "documents"))


def op13_merged_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13_merged_svd(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merge_dropout": op1_merge_dropout,
        "op2_randomness_battery": op2_randomness_battery,
        "op3_site_templates": op3_site_templates,
        "op4_golay_simhash": op4_golay_simhash,
        "op5_line_crf_quality": op5_line_crf_quality,
        "op6_block_max_wand": op6_block_max_wand,
        "op7_merkle_fixity": op7_merkle_fixity,
        "op8_token_counts": op8_token_counts,
        "op9_license_templates": op9_license_templates,
        "op10_benchmark_containment": op10_benchmark_containment,
        "op11_feistel_shards": op11_feistel_shards,
        "op12_relational_units": op12_relational_units,
        "op13_merged_svd": op13_merged_svd,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_block_max_wand": topk_search.op6_sql(),
        "op7_merkle_fixity": fixity.op7_sql(),
        "op9_license_templates": licenses.op9_sql(),
        "op10_benchmark_containment": decontaminate.op10_sql(),
        "op11_feistel_shards": feistel_shards.op11_sql(),
        "op12_relational_units": fill_middle.op12_sql(),
    }
