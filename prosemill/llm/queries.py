"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, importance_resampling, language_id, license_scan, line_dedup, mixing, ngram_join, packing, passage_dedup, prefix_trie, quality_rules, suffix_dedup, topk_search
from .common import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_mix(read_table(spark, sf_dir, "documents"))


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.op2_passages(read_table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.op3_topk(read_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op4_lines(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op5_bytes(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op6_license(read_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op7_packing(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op8_language(read_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op9_components(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op10_quality(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op11_trie(read_table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.op12_near_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.op13_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_ablations(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_passage_dedup": op2_passage_dedup,
        "op3_topk_search": op3_topk_search,
        "op4_line_dedup": op4_line_dedup,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_packing": op7_packing,
        "op8_language_id": op8_language_id,
        "op9_ngram_join": op9_ngram_join,
        "op10_quality_rules": op10_quality_rules,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_importance_resampling": op13_importance_resampling,
        "rule_ablations": rule_ablations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk_search": topk_search.OP3_SQL,
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op5_suffix_dedup": suffix_dedup.OP5_SQL,
        "op6_license_scan": license_scan.OP6_SQL,
        "op9_ngram_join": ngram_join.OP9_SQL,
        "op10_quality_rules": quality_rules.OP10_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_embedding_dedup": embedding_dedup.OP12_SQL,
        "op13_importance_resampling": importance_resampling.OP13_SQL,
        "rule_ablations": quality_rules.ABLATIONS_SQL,
    }
