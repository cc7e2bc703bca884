"""A proposal outline derived from the sections, and the place of each requirement in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import collapse

# Ids of the nodes that are no proposal content, volumes, the declaration of
# a factor, words about price, and types of duties after award.
UNASSIGNED, CRITERIA, POST_AWARD = "UNASSIGNED", "EVAL-CRITERIA", "POST-AWARD"
NON_PRICE, PRICE = "Non-Price Proposal", "Price Proposal"
FACTOR = r"(?U)Factor\s+(\d+)\s*[-–—:]\s*([A-Z][A-Za-z][A-Za-z /&'-]{2,40})"
PRICE_WORDS = r"(?iU)\b(price|pricing|cost|CLIN|SF1449|invoice|exhibit line item)\b"
DUTY_TYPES = ("sow_pws", "special_requirements", "clause", "attachment")


def section_texts(sections: DataFrame, pages: DataFrame, labels: tuple[str, ...] = ("L", "M")) -> DataFrame:
    """(file_id, dfs_ord, page_number, text) of the ok pages of top-level sections with these labels."""
    spread = sections.where("kind = 'pages' and parent_id is null").where(F.col("label").isin(*labels)).select("file_id", "dfs_ord", F.explode(F.sequence("unit_start", "unit_end")).alias("page_number"))
    return spread.join(pages.where("quality = 'ok' and text <> ''").select("file_id", "page_number", "text"), ["file_id", "page_number"])


def factor_titles(texts: DataFrame, order: list[str], pattern: str = FACTOR) -> DataFrame:
    """(number, title): the longest title that a factor is declared with, the first of equals."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("number"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("title"))
    rows = texts.select(*order, F.posexplode(both).alias("_i", "_f")).select(*order, "_i", "_f.*")
    title = F.regexp_replace(collapse(F.col("title")), r"[ \-–—:,]+$", "")
    rows = rows.withColumn("title", title)
    first = rows.groupBy("number", "title").agg(F.min(F.struct(*order, "_i")).alias("at"))
    size = first.groupBy("number").agg(F.max(F.length("title")).alias("size"))
    return first.join(size, "number").where(F.length("title") == F.col("size")).groupBy("number").agg(F.min_by("title", "at").alias("title"))


def derive_outline(files: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(node_ord, node_id, title, volume, parent_node_id, source_page).

    Two volumes, the factors in order, the paragraphs of L sections (base solicitations
    first, each label once), then three nodes for what is no proposal content.
    """
    spark = files.sparkSession
    schema = "rank int, sub long, node_id string, title string, volume string, parent_node_id string, source_page int"
    fixed = spark.createDataFrame(
        [
            (0, 0, "VOL-NONPRICE", NON_PRICE, NON_PRICE, None, None),
            (0, 1, "VOL-PRICE", PRICE, PRICE, None, None),
            (3, 0, CRITERIA, "Evaluation criteria — how the Government scores, not proposal content", "", None, None),
            (3, 1, POST_AWARD, "Post-award performance — not proposal content", "", None, None),
            (3, 2, UNASSIGNED, "Unassigned — no outline node matched", "", None, None),
        ],
        schema,
    )
    ok = files.where("parse_status = 'ok'").select("file_id", "file_ord", F.coalesce(F.col("doc_role") == "base_solicitation", F.lit(False)).alias("base"))
    texts = section_texts(sections, pages).join(ok.select("file_id", "file_ord"), "file_id")
    factors = factor_titles(texts, ["file_ord", "dfs_ord", "page_number"]).select(
        F.lit(1).alias("rank"), F.col("number").cast("long").alias("sub"), F.concat(F.lit("FACTOR-"), "number").alias("node_id"), F.concat(F.lit("Factor "), "number", F.lit(" - "), "title").alias("title"), F.lit(NON_PRICE).alias("volume"), F.lit("VOL-NONPRICE").alias("parent_node_id"), F.lit(None).cast("int").alias("source_page")
    )
    tops = sections.where("label = 'L' and parent_id is null").select(F.col("node_id").alias("parent_id"), "file_id")
    children = sections.join(tops, ["file_id", "parent_id"]).join(ok, "file_id")
    order = [F.desc("base"), F.col("file_ord"), F.col("dfs_ord")]
    first = children.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where("_n = 1")
    # the L paragraphs of a package are few: their order is one small window
    placed = first.withColumn("sub", F.row_number().over(Window.orderBy(*order)).cast("long"))
    price = F.col("title").rlike(PRICE_WORDS)
    paragraphs = placed.select(
        F.lit(2).alias("rank"), "sub", F.col("label").alias("node_id"), F.coalesce(F.nullif(F.regexp_replace(collapse(F.col("title")), ":+$", ""), F.lit("")), "label").alias("title"), F.when(price, PRICE).otherwise(NON_PRICE).alias("volume"), F.when(price, "VOL-PRICE").otherwise("VOL-NONPRICE").alias("parent_node_id"), F.when(F.col("kind") == "pages", F.col("unit_start")).cast("int").alias("source_page")
    )
    nodes = fixed.unionByName(factors).unionByName(paragraphs)
    return nodes.withColumn("node_ord", F.row_number().over(Window.orderBy("rank", "sub")) - 1).drop("rank", "sub")


def factor_patterns(outline: DataFrame) -> DataFrame:
    """(node_ord, node_id, pattern): words of four letters or more of a factor's title, or its number."""
    factors = outline.where("node_id like 'FACTOR-%'")
    number = F.substring_index("node_id", "-", -1)
    title = F.regexp_replace("title", r"^[^-]*-", "")
    words = F.regexp_extract_all(title, F.lit("[A-Za-z]{4,}"), F.lit(0))
    pattern = F.concat(F.lit("(?iU)"), F.array_join(F.array_append(words, F.concat(F.lit(r"Factor\s+"), number, F.lit("(?![0-9])"))), "|"))
    return factors.select("node_ord", "node_id", pattern.alias("pattern"))


def place(requirements: DataFrame, outline: DataFrame) -> DataFrame:
    """(requirement_id, node_id): first factor that matches, own label, price, post-award, criteria, unassigned.

    Outlines are a package's table of contents; their patterns go to each row as one array.
    """
    patterns = factor_patterns(outline).agg(F.array_sort(F.collect_list(F.struct("node_ord", "node_id", "pattern"))).alias("_patterns"))
    labels = outline.where(F.col("node_id") != UNASSIGNED).select(F.col("node_id").alias("_label")).distinct()
    rows = requirements.withColumn("_text", F.concat_ws(" ", F.coalesce("verbatim_text", F.lit("")), F.coalesce("atomic_obligation", F.lit(""))))
    rows = rows.join(F.broadcast(patterns)).join(labels, rows["section_label"] == labels["_label"], "left")
    factor = F.get(F.filter("_patterns", lambda p: F.rlike(F.col("_text"), p["pattern"])), F.lit(0))["node_id"]
    by_type = F.when(F.col("req_type").isin(*DUTY_TYPES), POST_AWARD).when(F.col("req_type") == "evaluation", CRITERIA).otherwise(UNASSIGNED)
    return rows.select("requirement_id", F.coalesce(factor, "_label", F.when(F.col("_text").rlike(PRICE_WORDS), "VOL-PRICE"), by_type).alias("node_id"))


def outline_coverage(placed: DataFrame) -> DataFrame:
    """(node_id, n)."""
    return placed.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
