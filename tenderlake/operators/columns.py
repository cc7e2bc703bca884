"""Column layout of pages: words with positions to lines, a body edge, and rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: A column edge starts this share of lines, lies so far from the margin, on pages of so many lines.
EDGE_SHARE, EDGE_OFFSET, LEAST_LINES = 0.25, 40.0, 6
#: Share of a page's height that running headers take; how far a start may lie off the margin.
HEADER_BAND, TOLERANCE = 0.12, 2.0


def visual_lines(words: DataFrame) -> DataFrame:
    """words (file_id, page_number, text, x0, top) with line (their rounded top) and line_x0."""
    line = F.bround("top").cast("int")
    return words.withColumn("line", line).withColumn("line_x0", F.min("x0").over(Window.partitionBy("file_id", "page_number", "line")))


def body_edges(words: DataFrame) -> DataFrame:
    """(file_id, page_number, edge): where most lines right of the margin start; the first in reading order of equals."""
    starts = visual_lines(words).groupBy("file_id", "page_number", "line").agg(F.bround(F.min("x0"), 1).alias("start"))
    page = starts.groupBy("file_id", "page_number").agg(F.min("start").alias("margin"), F.count(F.lit(1)).alias("lines"))
    right = starts.join(page, ["file_id", "page_number"]).where((F.col("lines") >= LEAST_LINES) & (F.col("start") - F.col("margin") >= EDGE_OFFSET))
    counts = right.groupBy("file_id", "page_number", "start", "lines").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    best = counts.groupBy("file_id", "page_number", "lines").agg(F.max_by(F.struct("start", "n"), F.struct("n", -F.col("first"))).alias("top"))
    return best.where(F.col("top.n") / F.col("lines") >= EDGE_SHARE).select("file_id", "page_number", F.col("top.start").alias("edge"))


def columnar_text(words: DataFrame, edges: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """(file_id, page_number, text): labels and bodies of table rows, row by row.

    A row starts where a line starts at the margin; lines of the header band stand alone.
    """
    page = ["file_id", "page_number"]
    rows = visual_lines(words).join(edges, page)
    if heights is None:
        rows = rows.withColumn("_header", F.lit(False))
    else:
        first = Window.partitionBy(*page, "line").orderBy("x0")
        rows = rows.join(heights, page).withColumn("_header", F.first("top").over(first) < F.col("height") * HEADER_BAND)
    rows = rows.withColumn("_margin", F.min("x0").over(Window.partitionBy(*page)))
    at = rows.select(*page, "line", "line_x0", "_margin", "_header").distinct()
    order = Window.partitionBy(*page).orderBy("line")
    opens = F.col("_header") | F.lag("_header", 1, True).over(order) | (F.col("line_x0") <= F.col("_margin") + TOLERANCE)
    at = at.withColumn("_opens", opens.cast("int")).withColumn("row", F.sum("_opens").over(order)).select(*page, "line", "row")
    placed = rows.join(at, [*page, "line"]).withColumn("_body", ~F.col("_header") & (F.col("x0") >= F.col("edge") - TOLERANCE))
    words_of = lambda body: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_body") == body, F.struct("line", "x0", "text")))), lambda w: w["text"]), " ")
    texts = placed.groupBy(*page, "row").agg(F.trim(words_of(False)).alias("label"), F.trim(words_of(True)).alias("body"))
    texts = texts.withColumn("text", F.trim(F.concat_ws(" ", F.nullif("label", F.lit("")), F.nullif("body", F.lit(""))))).where("text <> ''")
    return texts.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda r: r["text"]), "\n").alias("text"))


def columnar_or_plain(pages: DataFrame, words: DataFrame, heights: DataFrame) -> DataFrame:
    """pages with text from the layout where there is a body edge, and columnar (whether it was used)."""
    found = columnar_text(words, body_edges(words), heights).withColumnRenamed("text", "_laid")
    out = pages.join(found, ["file_id", "page_number"], "left")
    used = F.coalesce(F.trim("_laid") != "", F.lit(False))
    return out.withColumn("columnar", used).withColumn("text", F.when(used, F.col("_laid")).otherwise(F.col("text"))).drop("_laid")
