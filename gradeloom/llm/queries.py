"""The numbered operators as queries over the whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import (
    divergence, exact, fingerprints, language, lines, minhash, mixing, packing, pieces, repetitions, suffixes, toxicity, urls)
from gradeloom.llm.common import table


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    return packing.place(packing.with_digest(pieces))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_table(spark, urls.SITE_RULES + urls.WORD_RULES)
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passage_report(table(spark, sf_dir, "documents"))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=4)


def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_site_lines(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"), pieces.default_model())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_audit(table(spark, sf_dir, "documents"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitions.run_report(table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pattern_packing": op1_pattern_packing,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_fingerprints": op4_fingerprints,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_minhash_join": op6_minhash_join,
    "op7_site_lines": op7_site_lines,
    "op8_toxicity": op8_toxicity,
    "op9_piece_viterbi": op9_piece_viterbi,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_audit": op11_source_audit,
    "op12_word_runs": op12_word_runs,
    "op13_source_mix": op13_source_mix,
}

ORACLES = {
    "op3_url_filter": urls.oracle(),
    "op7_site_lines": lines.ORACLE,
    "op10_exact_dedup": exact.ORACLE,
    "op11_source_audit": divergence.ORACLE,
    "op13_source_mix": mixing.ORACLE,
}
