"""Cross-mapping of instructions, criteria and duties by similarity of their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fuzzy import token_set_similarity
from ..functions.text import normalize

THRESHOLD = 55.0
KINDS = ("mapped", "l_without_m", "m_without_l", "sow_without_either", "evaluation_process")
#: Rows of a pool that may be sent to every task; beyond that the pool meets its partners in blocks.
POOL_BLOCK = 20_000


def bucket(req_type: Column) -> Column:
    return F.when(req_type == "instruction", "L").when(req_type == "evaluation", "M").otherwise("C")


def candidates(rows: DataFrame, block: int = POOL_BLOCK) -> DataFrame:
    """Pairs (a, b, texts) of each row with the rows of its counterpart buckets, where both can be under one factor.

    factors has all factors of a row, and is null where it meets every factor.
    L meets M, M meets L, C meets both. Instructions and criteria are the query set: they
    are cut into blocks, and every row meets every block of its counterparts, so all tests
    are made; a task holds one block of a pool at a time.
    """
    pool = rows.where("bucket in ('L', 'M')")
    parts = max(1, -(-pool.count() // block))
    number = F.pmod(F.xxhash64("requirement_id"), F.lit(parts))
    pool = pool.select(number.alias("_part"), F.col("bucket").alias("_pool"), F.col("requirement_id").alias("b"), F.col("_text").alias("text_b"), F.col("factors").alias("factors_b"))
    wanted = F.when(F.col("bucket") == "L", F.array(F.lit("M"))).when(F.col("bucket") == "M", F.array(F.lit("L"))).otherwise(F.array(F.lit("L"), F.lit("M")))
    asked = rows.select(F.col("requirement_id").alias("a"), F.col("_text").alias("text_a"), F.col("factors").alias("factors_a"), F.explode(wanted).alias("_pool"))
    asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    # few rows make many pairs: they are dealt out before they meet
    asked = asked.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "a")
    same = F.col("factors_a").isNull() | F.col("factors_b").isNull() | F.arrays_overlap("factors_a", "factors_b")
    return asked.join(F.broadcast(pool) if parts == 1 else pool, ["_part", "_pool"]).where(same).select("a", "b", "text_a", "text_b")


def cross_map(requirements: DataFrame, factors: DataFrame | None = None, threshold: float = THRESHOLD, similarity=token_set_similarity, listed: bool = True) -> DataFrame:
    """One row per requirement: counterpart_ids (best first, all of them), gap_kind, rationale, score.

    Not listed: n, the count of all counterparts, in place of their ids, which are many more than the rows.
    """
    text = normalize(F.coalesce(F.nullif("atomic_obligation", F.lit("")), "verbatim_text"))
    rows = requirements.select("requirement_id", bucket(F.col("req_type")).alias("bucket"), text.alias("_text"))
    rows = rows.join(factors.select("requirement_id", "factor"), "requirement_id", "left") if factors is not None else rows.withColumn("factor", F.lit(None).cast("string"))
    # a text is scored once for all its rows; rows of one text and factor (a form) have the same counterparts
    rows = rows.withColumn("_key", F.sha2(F.to_json(F.struct("bucket", "_text")), 256))
    rows = rows.withColumn("_form", F.sha2(F.to_json(F.struct("_key", "factor")), 256))
    under = F.when(F.count("factor") == F.count(F.lit(1)), F.collect_set("factor")).alias("factors")
    texts = rows.groupBy(F.col("_key").alias("requirement_id"), "bucket", "_text").agg(under)
    scored = candidates(texts).select("a", "b", similarity(F.col("text_a"), F.col("text_b")).alias("score")).where(F.col("score") >= threshold)
    ids = F.collect_list("requirement_id") if listed else F.count(F.lit(1))
    forms = rows.groupBy("_form", "_key", "factor").agg(ids.alias("_ids"))
    mine = forms.select("_form", F.col("_key").alias("a"), F.col("factor").alias("factor_a"))
    theirs = forms.select(F.col("_key").alias("b"), F.col("factor").alias("factor_b"), "_ids")
    same = F.col("factor_a").isNull() | F.col("factor_b").isNull() | (F.col("factor_a") == F.col("factor_b"))
    met = scored.join(mine, "a").join(theirs, "b").where(same)
    if listed:
        found = F.transform("_ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("b"))).alias("_found")
        best = met.select("_form", found).groupBy("_form").agg(F.sort_array(F.flatten(F.collect_list("_found"))).alias("_found"))
        out = rows.join(best, "_form", "left")
        ids = F.coalesce(F.transform("_found", lambda x: x["b"]), F.array().cast("array<string>"))
        n, top, named = F.size(ids), -F.get("_found", F.lit(0))["less"], ids.alias("counterpart_ids")
    else:
        out = rows.join(met.groupBy("_form").agg(F.sum("_ids").alias("_n"), F.max("score").alias("_top")), "_form", "left")
        n, top = F.coalesce("_n", F.lit(0)), F.col("_top")
        named = n.alias("n")
    kind = F.when(n > 0, "mapped").when(F.col("bucket") == "L", "l_without_m").when((F.col("bucket") == "M") & F.col("factor").isNull(), "evaluation_process").when(F.col("bucket") == "M", "m_without_l").otherwise("sow_without_either")
    matched = lambda what: F.concat(F.lit("matched "), n.cast("string"), F.lit(what))
    # The rationale of each kind.
    why = (
        F.when((n > 0) & (F.col("bucket") == "L"), matched(" Section M criterion/criteria"))
        .when((n > 0) & (F.col("bucket") == "M"), matched(" Section L instruction(s)"))
        .when(n > 0, matched(" L/M requirement(s)"))
        .when(kind == "l_without_m", "no Section M evaluation criterion covers this instruction — work that will not be scored")
        .when(kind == "evaluation_process", "award/evaluation mechanics under no evaluation factor — describes how the competition is run, not a criterion a submittal answers")
        .when(kind == "m_without_l", "no Section L instruction tells the offeror to submit what this criterion scores")
        .otherwise("performance obligation with no instruction and no evaluation criterion — deliverable post-award, invisible pre-award")
    )
    return out.select("requirement_id", named, kind.alias("gap_kind"), why.alias("rationale"), F.coalesce(top, F.lit(0.0)).alias("score"))


def gap_summary(mappings: DataFrame) -> DataFrame:
    """(gap_kind, n) for all kinds, zeros included."""
    kinds = mappings.sparkSession.createDataFrame([(k,) for k in KINDS], "gap_kind string")
    counts = mappings.groupBy("gap_kind").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(counts, "gap_kind", "left").select("gap_kind", F.coalesce("n", F.lit(0)).alias("n"))
