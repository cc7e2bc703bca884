"""Token-id files: documents in key order, ids packed with Simple-8b.

A file set is a Parquet folder in the shared folder, so executors write it through
Spark's committed output and any of them can be lost. Each row is a chunk of documents
in key order: keys, token counts, 64-bit words and the word offsets of the blocks of
ids, for random access and vectorised decoding. Chunks carry their part, their number
in it and the ids before them in the part; parts are ranges of keys, so no global sort
in one place is needed and start positions come from the totals of parts alone.

Defined results: null and empty texts hold the end id alone; rows of equal keys follow
each other in the order of their texts; null keys come first; texts of any length are
encoded whole (a chunk is at least one document); empty tables make an empty file set.
Only key and text are read, so further columns can have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import simple8b
from .common import BROADCAST_BYTES, Texts, fields, new_path, slices, total_bytes
from .tokens import encoder, vocabulary_path

CHUNK_BYTES = 1 << 20
#: Text bytes of a part, about.
PART_BYTES = 32 << 20
NULL_KEY = np.iinfo(np.int64).min

CHUNKS = T.StructType(fields(part="int", chunk="int", before="long", n_ids="long", keys="binary", counts="binary", words="binary", offsets="binary"))


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                ids, counts = made.encode(Texts(batch.column(1)))
                # the end id goes behind each document
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                words, offsets = simple8b.encode(ids)
                keys = batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
                row = [part, chunk, before, len(ids), keys.astype(np.int64).tobytes(), (counts + 1).tobytes(), words.tobytes(), offsets.astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], CHUNKS.names)
                chunk, before = chunk + 1, before + len(ids)

    return run


def write_token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: str | None = None, path: str | None = None) -> str:
    """Encode docs into a file set; returns its path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    _, size = total_bytes(docs, text)
    parts = max(1, -(-size // PART_BYTES))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(parts, "key") if parts > 1 else rows.coalesce(1)
    # equal keys lie in one range; their texts settle the order
    chunks = ranged.sortWithinPartitions("key", "text").mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), CHUNKS)
    chunks.write.option("compression", "zstd").parquet(path)
    return path


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, n, keys, counts, words, offsets in zip(*(batch.column(c).to_pylist() for c in ("base", "n_ids", "keys", "counts", "words", "offsets"))):
            counts = np.frombuffer(counts, np.int64)
            ids = simple8b.decode(np.frombuffer(words, np.uint64), np.frombuffer(offsets, np.uint32).astype(np.int64), n).astype("<u4")
            keys = np.frombuffer(keys, np.int64)
            ends = np.cumsum(counts)
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends - counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, mask=keys == NULL_KEY), pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(np.append(0, 4 * ends)), pa.py_buffer(ids)]).cast(pa.binary())],
                ["key", "start", "n_tokens", "ids_crc32", "ids"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decode(batches):
        yield batch.select(["key", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document of a file set: key, start (ids of all before), n_tokens, ids_crc32 and, if wanted, ids (32-bit little-endian)."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    # totals of parts: a few bytes for each range of keys
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one short row per part: sent to all tasks unless there are too many
    few = (totals.count() or 1) * 32 <= BROADCAST_BYTES
    placed = chunks.join(F.broadcast(starts) if few else starts, "part").select((F.col("_start") + F.col("before")).alias("base"), "n_ids", "keys", "counts", "words", "offsets")
    out = fields(key="long", start="long", n_tokens="long", ids_crc32="long", **({"ids": "binary"} if with_ids else {}))
    return placed.mapInArrow(_decode if with_ids else _digest, T.StructType(out)).withColumnRenamed("key", key)
