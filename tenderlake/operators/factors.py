"""Evaluation factors: the headings that declare them, and which one a requirement stands under."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import WS, normalize
from .grounding import ground_on

#: Fixed value: a factor heading, an ordinal in brackets at the start of a line.
HEADING = r"(?iU)^[ \t]*\(\s*\d+\s*\)\s*Factor\s+(\d+)\s*[,:\-–—]"


def factor_anchors(pages: DataFrame, heading: str = HEADING, compose: bool = True) -> DataFrame:
    """(file_id, page, offset, factor) of ok pages: the offset is the length of the folded text before the heading."""
    ok = pages.where("quality = 'ok' and text <> ''")
    # cut before headings: what stands before one is folded once, not again for each that follows.
    # A line that begins with a word character may heal a hyphen before it, so no cut is made there.
    cut = rf"\n(?=(?m:(?={heading})))(?=[{WS}]*+(?![{WS}])(?U:\W))"
    parts = ok.select("file_id", F.col("page_number").alias("page"), F.posexplode(F.split("text", cut)).alias("_part", "_text"))
    parts = parts.withColumn("_n", F.length(normalize(F.concat("_text", F.lit("\n")), compose)))
    # a space parts texts that aren't empty
    many = Window.partitionBy("file_id", "page").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n") + 1)).over(many) - 1, F.lit(0)))
    rows = parts.withColumn("_lines", F.split("_text", "\n")).where(F.exists("_lines", lambda x: x.rlike(heading)))
    rows = rows.select("file_id", "page", "_before", "_lines", F.posexplode("_lines").alias("_i", "_line")).where(F.col("_line").rlike(heading))
    inside = F.length(normalize(F.concat(F.array_join(F.slice("_lines", F.lit(1), F.col("_i")), "\n"), F.lit("\n")), compose))
    gap = F.when((F.col("_before") > 0) & (inside > 0), 1).otherwise(0)
    return rows.select("file_id", "page", (F.col("_before") + gap + inside).cast("int").alias("offset"), F.concat(F.lit("FACTOR-"), F.regexp_extract("_line", heading, 1)).alias("factor"))


def as_of(requirements: DataFrame, anchors: DataFrame, by: str = "file_id") -> DataFrame:
    """(requirement_id, factor): the last anchor at or before a requirement's (page, offset).

    requirements (requirement_id, by, page, offset). Without an offset an anchor on the
    requirement's own page leaves it without a factor. Anchors and requirements go through
    one window per file, so nothing is joined by range.
    """
    a = anchors.select(by, "page", "offset", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("requirement_id"), "factor")
    none = F.lit(None).cast("string")
    r = requirements.where("page is not null").select(by, "page", F.coalesce("offset", F.lit(-1)).alias("offset"), F.lit(1).alias("_kind"), "requirement_id", none.alias("factor"))
    last = F.last("factor", ignorenulls=True).over(Window.partitionBy(by).orderBy("page", "offset", "_kind", "factor").rowsBetween(Window.unboundedPreceding, 0))
    here = F.max(F.when(F.col("_kind") == 0, True)).over(Window.partitionBy(by, "page"))
    seen = a.unionByName(r).withColumn("_last", last).withColumn("_here", here).where("_kind = 1")
    unknown = (F.col("offset") < 0) & F.coalesce("_here", F.lit(False))
    return seen.select("requirement_id", F.when(~unknown, F.col("_last")).alias("factor")).where("factor is not null")


def assign_factors(requirements: DataFrame, anchors: DataFrame, pages: DataFrame, compose: bool = True) -> DataFrame:
    """(requirement_id, factor), with offsets found by looking for the quote on its page."""
    texts = pages.where("quality = 'ok' and text <> ''").select("file_id", F.col("page_number").alias("page"), "text")
    asked = requirements.select("requirement_id", "file_id", "page", "verbatim_text")
    placed = ground_on(asked, texts, ["file_id", "page"], fuzzy=False, compose=compose)
    # an empty quote stands at a text's begin
    begins = F.when(normalize(F.col("verbatim_text"), compose) == "", 0)
    if_any = placed.join(texts.select("file_id", "page", F.lit(True).alias("_read")), ["file_id", "page"], "left")
    return as_of(if_any.withColumn("offset", F.coalesce("char_start", F.when(F.col("_read"), begins))), anchors)


def factor_coverage(requirements: DataFrame, assigned: DataFrame) -> DataFrame:
    """(factor, n) of all requirements, with 'no factor' for those under none."""
    found = requirements.select("requirement_id").join(assigned, "requirement_id", "left")
    return found.groupBy(F.coalesce("factor", F.lit("no factor")).alias("factor")).agg(F.count(F.lit(1)).alias("n"))
