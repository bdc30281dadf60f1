"""Named queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_license,
    op2_quality,
    op3_mixing,
    op4_tokens,
    op5_jaccard,
    op6_suffix,
    op7_html,
    op8_decontaminate,
    op9_url,
    op10_language,
    op11_bpe,
    op12_phrases,
    op13_runs,
)
from .common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_license.scan(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality.apply_policy(op2_quality.ledger(read_table(spark, sf_dir, "documents")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixing.mix(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op4_tokens.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_jaccard.join_report(read_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_suffix.dedup_report(read_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_html.extract(read_table(spark, sf_dir, "pages"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_url.judge(read_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = op10_language.fit(read_table(spark, sf_dir, "documents"))
    return op10_language.identify(read_table(spark, sf_dir, "pages"), model)


def op11_bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op11_bpe.report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_runs.find_runs(read_table(spark, sf_dir, "documents"), plant=op13_runs.planted)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_rules, op3_mix_sources, op4_token_counts, op5_jaccard_join, op6_suffix_dedup, op7_html_text,
    op8_benchmark_leaks, op9_url_filter, op10_language_id, op11_bpe_ids,
    op12_collocations, op13_word_runs)}
ORACLE_SQL = {"op1_license_scan": op1_license.SQL, "op2_quality_rules": op2_quality.SQL, "op3_mix_sources": op3_mixing.SQL,
              "op9_url_filter": op9_url.SQL, "op12_collocations": op12_phrases.SQL}
