"""Compliance verdicts: the worklist for a judge, and joining and counting what it says."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

VERDICTS = ("fully_compliant", "partially_compliant", "non_compliant", "unknown")


def judgment_tasks(requirements: DataFrame, profile_id: str) -> DataFrame:
    return requirements.select("requirement_id", "display_label", "req_type", F.col("section_label").alias("section"), "page", "verbatim_text", "atomic_obligation", F.lit(profile_id).alias("profile_id"))


def apply_verdicts(requirements: DataFrame, verdicts: DataFrame, order: list[str]) -> DataFrame:
    """Verdicts of requirements that have one, with the columns that give their order."""
    return requirements.select("requirement_id", *order).join(verdicts, "requirement_id")


def judgment_summary(judgments: DataFrame, requirements: DataFrame) -> DataFrame:
    """(verdict, n) for all verdicts, zeros included, and not_judged."""
    spark = judgments.sparkSession
    kinds = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    counts = judgments.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    named = F.broadcast(kinds).join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))
    total = requirements.agg(F.count(F.lit(1)).alias("t")).join(judgments.agg(F.count(F.lit(1)).alias("j")))
    return named.unionByName(total.select(F.lit("not_judged").alias("verdict"), F.greatest(F.col("t") - F.col("j"), F.lit(0)).alias("n")))
