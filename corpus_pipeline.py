"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage works on all that the one before it kept. Filters drop whole documents;
substring dedup shortens texts and sets n_chars anew; the last stage returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlake.llm.common import drop, stored, table
from tenderlake.llm.decontaminate import decontaminated
from tenderlake.llm.near_dedup import one_of_each
from tenderlake.llm.sentencepiece_codec import encoded
from tenderlake.llm.substring_dedup import without_repeats
from tenderlake.llm.toxicity import harmless, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, doesn't reject."""
    return harmless(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that an earlier document has; all else in them stays."""
    kept = without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each document's pieces."""
    return encoded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Lexicons, signatures and pieces are not for SQL: tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, made = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if path:
            drop(spark, path)
        path = made
    return STAGES[-1][1](spark, docs, sf_dir)
