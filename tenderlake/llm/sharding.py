"""Proportional stratified interleaving: shards that all have the mixture of the whole.

Rows of each source are put in a seeded order and ranked; (rank - 1/2) / rows of the
source spreads every source evenly over (0, 1). Sorting all rows by that fraction and
cutting the line into equal runs gives shards whose source counts follow the mixture.

Ranks are found without one task ever holding a source: rows fall into buckets that
follow the order (by the leading bits of the seeded hash, then by the fraction), small
tables of bucket counts are summed to offsets, and only rows of one bucket are sorted
together. The number of buckets follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a bucket, about; a bucket is sorted in one task.
BUCKET_ROWS = 2_000


def _ranked(rows: DataFrame, keys: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """rows with rank: their 1-based place by bucket and order within keys (or all rows)."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    # keys may be few and the buckets many: sum in two levels so that no window holds all buckets of the whole
    block = (F.col(bucket) / 1000).cast("long")
    blocks = counts.groupBy(*keys, block.alias("_block")).agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_blocks"))
    inside = Window.partitionBy(*keys, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_block", block).withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    offsets = counts.join(blocks, [*keys, "_block"]).select(*keys, bucket, (F.col("_blocks") + F.col("_before")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return rows.withColumn("rank", place).join(offsets, [*keys, bucket]).withColumn("rank", F.col("_offset") + F.col("rank")).drop("_offset")


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 17, key: str = "doc_id", stratum: str = "source", text: str = "text") -> DataFrame:
    """Per row: its key, size, text_crc32, law, shard, slot and grown_shard (null: the law is rows).

    Shard counts differ by one at most; slots of a shard run from 0 without gaps, in the
    interleaved order. Of a stratum's rows each shard gets its share within one or two rows.

    Defined results: a null stratum is a stratum of its own, a null text has size 1 and the
    checksum of no bytes; rows that agree in key, stratum and text are interchangeable, so
    repeated rows and ties fall into neighbouring places; texts of any length count by their
    bytes; an empty table gives an empty table. Only the named columns are read, so further
    columns, whatever their names, make no difference.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-"))
    lead = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(key), name.alias("_stratum"), lead.alias("_lead"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    total = docs.select(F.lit(1)).count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    width = -(-(1 << 60) // buckets)
    rows = rows.withColumn("_bucket", (F.col("_lead") / F.lit(width).cast("double")).cast("long"))
    order = [F.col("_lead"), F.col(key), F.col("text_crc32"), F.col("size")]
    ranked = _ranked(rows, ["_stratum"], "_bucket", order).drop("_bucket")
    sizes = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"))
    placed = ranked.join(sizes, "_stratum").withColumn("_fraction", (2 * F.col("rank") - 1) / (2.0 * F.col("_rows")))
    placed = placed.withColumn("_bucket", F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    placed = _ranked(placed.drop("rank"), [], "_bucket", [F.col("_fraction"), F.col("_stratum"), *order])
    place = F.col("rank") - 1
    shard = F.expr(f"(rank - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")  # the first place of the shard
    return placed.withColumn("shard", shard).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (place - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.when(F.col("_stratum") != "-", F.expr("substring(_stratum, 2)")).alias("stratum")
    )
