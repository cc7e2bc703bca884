"""Pages as a stream: gated on arrival, counted by window, repeated content dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import chunk_key
from ..operators.quality import Thresholds, classify_pages


def page_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def gated(pages: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The quality gate needs no state: it is the batch operator."""
    return classify_pages(pages, t)


def new_content(pages: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Pages whose content key was not seen within the watermark; state is bounded by it."""
    return pages.withColumn("chunk_key", chunk_key(F.col("text"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["chunk_key"])


def event_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, kind, n, total) per tumbling or sliding window, closed by the watermark."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, late).groupBy(window, kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n", "total")
