"""Shared plumbing: table access, shared-folder tables, and vectorised word hashing.

Text kernels work on the UTF-8 buffers of Arrow string arrays. A word is a
maximal run of "word bytes"; every hash is 64 bits wide and depends on the bytes
of the word alone, so it is the same in every task, at every size and on retry.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

U64 = np.uint64
#: Bytes and documents that a kernel works on at once; a longer document is one slice.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 500
#: Largest table, in bytes of its collected columns, that may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; the session's own setting afterwards."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


# --- tables in the shared folder -------------------------------------------

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a fresh local one where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tenderlake-"))
    return _local[0]


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing will read any more."""
    for path in paths:
        drop_path(spark, path)
        if (spark, path) in _made:
            _made.remove((spark, path))


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tenderlake/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str, rows: int = 500) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. rows: of an Arrow batch on the way."""
    path = new_path(df.sparkSession, name)
    with short_batches(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: A hot key's rows are dealt to places of about so many of all rows of the join.
PLACES = 1000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, count: str) -> DataFrame:
    """left joined with right, which has each key once; counts says how many rows left has of each key.

    Rows of a key with more than two thousandths of all are dealt to several places by a
    hash, and the key's row of right is copied to each: at most 2 * PLACES copies in all,
    and a list of fewer than PLACES keys that every task gets.
    """
    total, most = counts.agg(F.sum(count), F.max(count)).first()
    unit = max((total or 0) // PLACES, 16)
    if (most or 0) <= 2 * unit:
        return left.join(right, on)
    hot = F.broadcast(counts.where(F.col(count) > 2 * unit).select(*on, F.ceil(F.col(count) / unit).cast("int").alias("_tl_places")))
    places = F.coalesce("_tl_places", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_tl_place", F.pmod(F.xxhash64(*left.columns), places).cast("int")).drop("_tl_places")
    copied = right.join(hot, on, "left").withColumn("_tl_place", F.explode(F.sequence(F.lit(0), places - 1))).drop("_tl_places")
    return dealt.join(copied, [*on, "_tl_place"]).drop("_tl_place")


# --- words ---------------------------------------------------------------------

#: Word bytes: everything but ASCII white space.
NON_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Word bytes: ASCII digits and letters and all bytes of non-ASCII characters.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

_SEED = np.random.default_rng(20240607)
_BYTES = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
_R = U64(0x9E3779B97F4A7C15)
_R_INVERSE = U64(pow(int(_R), -1, 1 << 64))
_GRAM = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        ups, downs = np.full(size, _R), np.full(size, _R_INVERSE)
        ups[0] = downs[0] = 1
        _powers[size] = (np.multiply.accumulate(ups), np.multiply.accumulate(downs))
    return _powers[size]


def word_spans(data: np.ndarray, doc_starts: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; no word crosses a document's start."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_bytes[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = doc_starts[doc_starts < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of each byte span; with fold, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + (1 << 18), "right")))
        high = ends[to - 1]
        up, down = _power_table(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTES)[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _GRAM[0])
        at = to
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; position i covers words i to i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _GRAM[k % 64]
    for j in range(1, k):
        total = mix(total) + words[j : j + n] * _GRAM[j % 64] if j % 8 == 0 else total + words[j : j + n] * _GRAM[j % 64] * U64(2 * j + 1)
    return mix(total)


class Texts:
    """The documents of an Arrow string or binary array as one byte buffer."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        else:
            column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0] if len(column) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, word_bytes: np.ndarray = NON_SPACE, fold: bool = False) -> Words:
        starts, ends = word_spans(self.data, self.offsets[:-1], word_bytes)
        return Words(span_hashes(self.data, starts, ends, fold), starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Word hashes and byte spans; document i has words doc[i] to doc[i + 1] - 1."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
        self.hashes, self.starts, self.ends, self.doc = hashes, starts, ends, doc

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes at all positions, and which of them stay within one document."""
        found = gram_hashes(self.hashes, k)
        room = np.repeat(self.doc[1:], np.diff(self.doc)) - np.arange(len(self.hashes))
        return found, room[: len(found)] >= k


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes of text and SLICE_ROWS rows, or one document."""
    if not batch.num_rows:
        return
    sizes = np.diff(Texts(batch.column(batch.schema.get_field_index(text))).offsets)
    at, total, since = 0, 0, 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > most or i - at >= SLICE_ROWS):
            yield batch.slice(at, i - at)
            since += total
            if since > 8 * most:
                give_back()
                since = 0
            at, total = i, 0
        total += int(n)
    yield batch.slice(at)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers are reused and share their executor's bound."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  not in every C library
except (OSError, AttributeError):
    _libc = None


TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType())}


def fields(**kinds: str) -> list[T.StructField]:
    """Fields by short type names, for schemas that are made where no session is at hand."""
    return [T.StructField(name, TYPES[kind]) for name, kind in kinds.items()]


def total_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, by one aggregation."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return row[0], row[1] or 0
