"""The driver's synthetic tables seen as packages, pages, lines, drafts and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of a bucket: documents of one source and bucket are numbered in one task.
BUCKET_IDS = 10_000


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: a source is a file, its documents by id are its pages.

    Numbered in two steps, so that no task holds a source: places inside a bucket of ids,
    and sums of the buckets before it.
    """
    bucket = F.floor(F.col("doc_id") / BUCKET_IDS).alias("_bucket")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("file_id"), "text", F.col("n_chars").alias("char_count"), bucket)
    counts = docs.groupBy("file_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("file_id", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("file_id", "_bucket").orderBy("doc_id"))
    rows = docs.withColumn("_place", place).join(offsets, ["file_id", "_bucket"])
    return rows.select("doc_id", "lang", "file_id", (F.col("_before") + F.col("_place")).cast("int").alias("page_number"), "text", "char_count", F.lit(None).cast("map<string,double>").alias("metrics"))


#: orders as lines of a solicitation, in SQL that Spark and the oracle share: an order is a line, its key gives file and page.
LINES = """
SELECT 'F' || CAST(k % 25 AS STRING) AS file_id, CAST(1 + CAST(floor(k / 25) AS BIGINT) % 30 AS INT) AS page_number, k,
  CAST(row_number() OVER (PARTITION BY k % 25, CAST(floor(k / 25) AS BIGINT) % 30 ORDER BY k) - 1 AS INT) AS line_index,
  CASE kind
    WHEN 0 THEN 'SECTION ' || letter || ' - ' || words
    WHEN 1 THEN letter || '.' || CAST(c % 5 + 1 AS STRING) || ' ' || words
    WHEN 2 THEN letter || '.' || CAST(c % 5 + 1 AS STRING) || '.' || CAST(c % 3 + 1 AS STRING) || ' Pricing of ' || words
    WHEN 3 THEN 'PART II - ' || words
    WHEN 4 THEN 'Evaluation Factors for Award'
    WHEN 5 THEN 'Section ' || letter || ' of this solicitation is amended'
    WHEN 6 THEN 'The offeror shall submit a plan for ' || words || '.'
    WHEN 7 THEN 'The Government will evaluate the plan for ' || words || '.'
    WHEN 8 THEN '(1) Factor ' || CAST(c % 4 + 1 AS STRING) || ', ' || words
    WHEN 9 THEN 'See Factor ' || CAST(c % 4 + 1 AS STRING) || ' - Corporate ' || CASE WHEN c % 2 = 0 THEN 'Experience' ELSE 'Approach' END || ': read on.'
    WHEN 10 THEN 'Section ' || letter || '.' || CAST(c % 5 + 1 AS STRING) || ' is hereby changed to read anew.'
    WHEN 11 THEN 'Page ' || CAST(k % 30 AS STRING) || ' of 30'
    WHEN 12 THEN 'Solicitation Header'
    WHEN 13 THEN 'Contractors must keep records of ' || words || ' at no cost.'
    WHEN 14 THEN 'A bidder should not rely on ' || words || ', e.g. under para. ' || letter || '.' || CAST(c % 5 + 1 AS STRING) || '. It shall not copy it.'
    ELSE 'SECTION ' || letter || ' - ' || words || ' .... ' || CAST(c % 90 + 1 AS STRING) END AS line,
  kind, letter, c
FROM (SELECT o_orderkey AS k, o_custkey AS c, (o_orderkey * 7 + o_custkey) % 16 AS kind, substr('ABCDEFGHIJKLM', CAST(o_custkey % 13 AS INT) + 1, 1) AS letter,
  lower(substr(o_orderpriority, 3)) || ' item' || CAST(o_custkey % 40 AS STRING) AS words FROM orders)
"""


def solicitation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, page_number, line_index, line, ...) made from orders."""
    return spark.sql(LINES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def solicitation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page as text: (file_id, page_number, text, char_count, quality)."""
    lines = solicitation_lines(spark, sf_dir)
    rows = lines.groupBy("file_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return rows.withColumns({"char_count": F.length("text"), "quality": F.lit("ok")})


def solicitation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_name, file_ord, file_id, filename, file_type, parse_status, doc_role, page_count); five files make a package."""
    number = F.expr("CAST(substring(file_id, 2) AS INT)")
    rows = solicitation_lines(spark, sf_dir).groupBy("file_id").agg(F.max("page_number").alias("page_count"))
    role = F.when(number % 5 == 0, "base_solicitation").when(number % 5 == 1, "amendment").otherwise("attachment")
    return rows.select(F.concat(F.lit("P"), F.floor(number / 5).cast("string")).alias("package_name"), number.alias("file_ord"), "file_id", F.concat("file_id", F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("file_type"), F.lit("ok").alias("parse_status"), role.alias("doc_role"), "page_count")


def solicitation_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that bind somebody, as requirements of their pages."""
    rows = solicitation_lines(spark, sf_dir).where("kind in (6, 7, 10, 13, 14)")
    number = F.expr("CAST(substring(file_id, 2) AS INT)")
    kind = F.when(F.col("kind") == 6, "instruction").when(F.col("kind") == 7, "evaluation").when(F.col("kind") == 10, "clause").otherwise("sow_pws")
    return rows.select(
        F.concat(F.lit("R"), F.format_string("%08d", "k")).alias("requirement_id"), F.col("k").alias("req_ord"), "file_id", F.concat("file_id", F.lit(".pdf")).alias("filename"), F.col("page_number").alias("page"), F.col("line").alias("verbatim_text"), F.lit("").alias("atomic_obligation"),
        F.lit("none").alias("binding_keyword"), kind.alias("req_type"), F.concat(F.col("letter"), F.lit("."), (F.col("c") % 5 + 1).cast("string")).alias("section_label"), F.when(number % 5 == 1, "amendment").otherwise("attachment").alias("doc_role"), (F.col("k") % 3 > 0).alias("verified"), F.col("k").cast("string").alias("display_label"),
    )
