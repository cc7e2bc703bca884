"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import stored, table
from .decontaminate import contamination
from .near_dedup import near_duplicates
from .quality_classifier import quality_scores
from .quality_rules import apply_rules
from .sentencepiece_codec import round_trips
from .sharding import stratified_shards
from .substring_dedup import repeat_digests
from .token_counts import length_histogram, with_suffix_sums
from .token_files import read_token_files, write_token_files
from .toxicity import learn as learn_lexicon, scored as score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents")), with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both sums read the histogram: it is written, so that texts are encoded once
    histogram, _ = stored(length_histogram(table(spark, sf_dir, "documents")), "lengths")
    return with_suffix_sums(histogram)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_token_files": op4_token_files,
        "op5_toxicity": op5_toxicity,
        "op6_sharding": op6_sharding,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_token_counts": op9_token_counts,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": oracles.DECONTAMINATION,
        "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op10_quality_rules": oracles.QUALITY_RULES,
    }
