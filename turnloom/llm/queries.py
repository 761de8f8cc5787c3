"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import chat, decontam, fim, licenses, lines, mixing, ogg, quality, sharding, simhash, spelling, suffix, toxicity
from turnloom.llm.common import read_table


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(read_table(spark, sf_dir, "documents"))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(read_table(spark, sf_dir, "conversations"))


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(read_table(spark, sf_dir, "documents"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ogg_media, op2_snapshot_collapse, op3_ordinal_toxicity, op4_pareto_mix, op5_license_scan,
        op6_attention_quality, op7_simhash_bktree, op8_suffix_repeats, op9_fuzzy_lines, op10_benchmark_leaks,
        op11_spelling_variants, op12_jump_shards, op13_fill_in_middle,
    )
}
ORACLES: dict[str, str] = {"op2_snapshot_collapse": chat.ORACLE, "op4_pareto_mix": mixing.ORACLE, "op13_fill_in_middle": fim.ORACLE}
