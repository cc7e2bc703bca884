"""Token counts by an exact histogram of encoded lengths.

Documents are encoded and only their lengths kept: one row per length, aggregated on the
map side first. Suffix sums over lengths answer, for every context limit L, how many
documents have at least L tokens, how many tokens the corpus keeps when documents are
cut at L, and which share of documents fits.

Defined results: no limits or shares give empty tables; null and empty texts have length 0; repeated rows count each time;
texts of any length are encoded whole; an empty table gives an empty histogram. Only the
text is read, so further columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import Texts, fields, slices
from .tokens import encoder, vocabulary_path

#: Lengths of a block of suffix sums; blocks are summed first, then inside each.
SPAN = 256


def _lengths(vocabulary: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, text):
                _, counts = made.encode(Texts(batch.column(0)))
                value, docs = np.unique(counts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(docs, pa.int64())], ["n_tokens", "docs"])

    return run


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, docs) of each encoded length."""
    found = docs.select(text).mapInArrow(_lengths(vocabulary or vocabulary_path(), text), T.StructType(fields(n_tokens="long", docs="long")))
    return found.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L: docs, docs_at_least and tokens_at_least (of documents of L or more), total_tokens,
    truncated_tokens (kept if all documents are cut at L), share_within (documents of L or fewer)."""
    rows = histogram.withColumn("_block", F.floor(F.col("n_tokens") / SPAN)).withColumn("_tokens", F.col("n_tokens") * F.col("docs"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    whole = Window.partitionBy()
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_docs_after"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_tokens_after"), F.sum("_d").over(whole).alias("_docs_all"), F.sum("_t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(blocks, "_block").withColumn("docs_at_least", F.col("_docs_after") + F.sum("docs").over(inside)).withColumn("tokens_at_least", F.col("_tokens_after") + F.sum("_tokens").over(inside))
    kept = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    within = (F.col("_docs_all") - F.col("docs_at_least") + F.col("docs")) / F.col("_docs_all")
    return out.select("n_tokens", "docs", "docs_at_least", "tokens_at_least", "total_tokens", kept.alias("truncated_tokens"), within.alias("share_within"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_cut) for any limits, also such that no document has."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], T.StructType(fields(context_limit="long")))
    found = histogram.select("n_tokens", "docs", F.explode(F.array(*[F.lit(x).cast("long") for x in limits]).cast("array<bigint>")).alias("context_limit"))
    sums = found.groupBy("context_limit").agg(F.sum(F.least("n_tokens", "context_limit") * F.col("docs")).alias("truncated_tokens"), F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("docs")).otherwise(0)).alias("docs_cut"))
    return asked.join(sums, "context_limit", "left").fillna(0)


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that so many of the documents do not exceed."""
    rows = with_suffix_sums(histogram)
    return rows.select("n_tokens", "share_within", F.explode(F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>")).alias("share")).where("share_within >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
