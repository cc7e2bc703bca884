"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Random indexing over all documents: every token has a sparse random index vector, and
   each token's context vector is the sum of the index vectors of its neighbours. Tokens
   are words (hashed to a fixed number of rows) and word shapes (letter case, attached
   signs, length, whether the word repeats its predecessor). Each task adds up one table
   of fixed size; tables are summed by chunks of rows, in whole numbers, so the result
   does not depend on order or retries.
2. A document is pooled to the mean of its tokens' unit vectors, words and shapes apart,
   and its length.
3. A network with one hidden layer is trained in numpy on a bounded sample of labelled
   rows outside the held-out fold; a temperature fitted on a part kept aside calibrates
   its probabilities.

Defined results: null and empty texts pool to zeros and get the network's score for
them; texts of any length are pooled whole; repeated rows get equal scores; null labels
and null keys in the labels are left out, of several labels of a key the mean counts;
with labels of one kind or none every score is the share of label 1 (0.5 with none).
Only key and text are read, so further columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import NON_SPACE, U64, Texts, fields, mix, slices
from .toxicity import held_out

#: Rows of the word table, dimensions, and non-zero places of an index vector.
ROWS, DIM, PLACES = 1 << 14, 64, 4
#: Rows of the shape table.
SHAPES = 1 << 9
WINDOW = 2
#: Labelled rows that the network is trained on, at most.
SAMPLE = 12_000
HIDDEN, STEPS = 32, 400
CHUNK = 512  # table rows of a chunk in the shuffle
#: Word pairs that are held before they are counted.
PAIRS = 4 << 20

_CLASS = np.full(256, 32, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 4, 1
for _b in b"#*$%&|<>@^~=+_{}[]\\":
    _CLASS[_b] = 8
for _b in b".,;:!?'\"()-/":
    _CLASS[_b] = 16


class Tokens:
    """Word rows and shape rows of a slice of documents, with owners."""

    def __init__(self, texts: Texts):
        words = texts.words(NON_SPACE, fold=True)
        self.owner, self.n_docs, self.counts = words.owner(), len(texts), np.diff(words.doc)
        self.word = (words.hashes >> U64(50)).astype(np.int64)
        n = len(self.word)
        if not n:
            self.shape = np.zeros(0, np.int64)
            return
        # the bytes from one word's start to the next's: white space between is of no class
        kinds = _CLASS[texts.data]
        has = np.bitwise_or.reduceat(kinds, words.starts)
        upper = np.add.reduceat((kinds == 2).view(np.uint8), words.starts, dtype=np.int32)
        stops = np.add.reduceat((kinds == 16).view(np.uint8), words.starts, dtype=np.int32)
        size = words.ends - words.starts
        letters, signs, digits = (has & 3) > 0, (has & 8) > 0, (has & 4) > 0
        case = np.where(~letters, 0, np.where(upper == 0, 1, np.where(((has & 1) == 0) & (upper > 1), 3, 2)))
        mark = np.where(~signs, np.where(stops > 1, 1, 0), np.where(has == 8, 3, 2))
        same = np.zeros(n, np.int64)
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (self.owner[1:] == self.owner[:-1])
        span = np.minimum(np.log2(size).astype(np.int64), 5)
        self.shape = ((((case * 4 + mark) * 2 + same) * 2 + digits) * 8 + span).astype(np.int64)


def index_vectors(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector."""
    h = mix(np.arange(rows, dtype=np.uint64)[:, None] * U64(PLACES) + np.arange(PLACES, dtype=np.uint64) + U64(seed << 32))
    return (h % U64(DIM)).astype(np.int64), np.where((h >> U64(40)) & U64(1), 1, -1).astype(np.int64)


class Contexts:
    """Sums of neighbours' index vectors: a row for each word row, then for each shape row.

    Pairs of neighbours are counted first, over many slices, and each distinct pair is
    added once, in whole numbers. Words see words; shapes see shapes.
    """

    def __init__(self) -> None:
        self.table = np.zeros((ROWS + SHAPES, DIM), np.int64)
        self.words: list[np.ndarray] = []
        self.held = 0
        self.shapes = np.zeros(SHAPES * SHAPES, np.int64)

    def add(self, tokens: Tokens) -> None:
        word = tokens.word.astype(np.uint32)
        for k in range(1, WINDOW + 1):
            near = tokens.owner[k:] == tokens.owner[:-k]
            self.words.append((word[:-k] * np.uint32(ROWS) + word[k:])[near])
            self.held += len(self.words[-1])
            self.shapes += np.bincount((tokens.shape[:-k] * SHAPES + tokens.shape[k:])[near], minlength=SHAPES * SHAPES)
        if self.held >= PAIRS:
            self._flush()

    def _flush(self) -> None:
        pairs = np.sort(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint32)
        self.words, self.held = [], 0
        heads = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
        distinct = pairs[heads].astype(np.int64)
        self._project(distinct // ROWS, distinct % ROWS, np.diff(np.append(heads, len(pairs))), 0, ROWS)

    def _project(self, left: np.ndarray, right: np.ndarray, times: np.ndarray, base: int, rows: int) -> None:
        places, signs = index_vectors(ROWS + SHAPES, 11)
        for at, seen in ((left, right), (right, left)):
            for p in range(PLACES):
                sums = np.bincount(at * DIM + places[base + seen, p], weights=signs[base + seen, p] * times, minlength=rows * DIM)
                self.table[base : base + rows] += sums.astype(np.int64).reshape(rows, DIM)

    def sums(self) -> np.ndarray:
        self._flush()
        some = np.flatnonzero(self.shapes)
        self._project(some // SHAPES, some % SHAPES, self.shapes[some], ROWS, SHAPES)
        self.shapes[:] = 0
        return self.table


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Contexts()
    for whole in batches:
        for batch in slices(whole, whole.schema.names[0]):
            found.add(Tokens(Texts(batch.column(0))))
    yield _chunks(found.sums())


def _chunks(table: np.ndarray) -> pa.RecordBatch:
    parts = [table[i : i + CHUNK] for i in range(0, len(table), CHUNK)]
    kept = [i for i, p in enumerate(parts) if p.any()]
    # bytes of equal weight together: the high ones are nearly constant and compress away
    blobs = [np.ascontiguousarray(parts[i].reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes() for i in kept]
    return pa.RecordBatch.from_pydict({"chunk": pa.array(kept, pa.int32()), "sums": pa.array(blobs, pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal chunks, one row at a time: a task holds one table at most."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("sums")):
            got = np.ascontiguousarray(np.frombuffer(blob.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
            sums[chunk] = sums[chunk] + got if chunk in sums else got
    for chunk, got in sums.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "sums": pa.array([np.ascontiguousarray(got.view(np.uint8).reshape(-1, 8).T).tobytes()], pa.binary())})


CHUNKS = T.StructType(fields(chunk="int", sums="binary"))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all rows, from the whole of docs; a table of fixed size (4 MB)."""
    partial = docs.select(text).mapInArrow(_partial, CHUNKS)
    # two steps: as many tasks as there are chunks and salts, then one sum per chunk
    some = partial.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(8))).repartition("chunk", "_salt").select("chunk", "sums").mapInArrow(_added, CHUNKS)
    whole = some.repartition("chunk").mapInArrow(_added, CHUNKS)
    table = np.zeros((ROWS + SHAPES, DIM))
    for row in whole.collect():
        got = np.ascontiguousarray(np.frombuffer(row.sums, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1, DIM)
        table[row.chunk * CHUNK : row.chunk * CHUNK + len(got)] = got
    # a row's own index vector tells it apart where contexts agree
    places, signs = index_vectors(ROWS + SHAPES, 11)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, norm, out=np.zeros_like(table), where=norm > 0)
    for p in range(PLACES):
        np.add.at(table, (np.arange(len(table)), places[:, p]), signs[:, p] / PLACES)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Per document: mean word vector, mean shape vector, and log length.

    Distinct words of a document are counted, and the counts multiplied with their vectors,
    document by document, so a document's values don't depend on those around it.
    """
    n = tokens.n_docs
    out = np.zeros((n, 2 * DIM + 1), np.float32)
    key = np.sort((tokens.owner * ROWS + tokens.word).astype(np.uint32 if n * ROWS < 1 << 32 else np.int64))
    heads = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    times = np.diff(np.append(heads, len(key))).astype(np.float32)
    key = key[heads].astype(np.int64)
    rows, cuts = key % ROWS, np.searchsorted(key, np.arange(n + 1) * ROWS)
    for i in np.flatnonzero(tokens.counts):
        a, b = cuts[i], cuts[i + 1]
        out[i, :DIM] = times[a:b] @ vectors.take(rows[a:b], axis=0)
    for low in range(0, n, 4096):  # documents at a time, to bound the counts
        here = slice(*np.searchsorted(tokens.owner, (low, low + 4096)))
        size = min(4096, n - low)
        counts = np.bincount((tokens.owner[here] - low) * SHAPES + tokens.shape[here], minlength=size * SHAPES)
        out[low : low + size, DIM : 2 * DIM] = counts.reshape(size, SHAPES).astype(np.float32) @ vectors[ROWS:]
    out[:, : 2 * DIM] /= np.maximum(tokens.counts, 1)[:, None]
    out[:, -1] = np.log1p(tokens.counts) / 5.0
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(2 * DIM + 1), np.ones(2 * DIM + 1), np.zeros((2 * DIM + 1, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3) -> Network:
    """Adam on the cross-entropy of four fifths; the temperature on the rest."""
    if len(set(y.tolist())) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    aside = rng.permutation(len(y)) < len(y) // 5
    if len(set(y[~aside].tolist())) < 2 or aside.sum() < 20:
        aside = np.zeros(len(y), bool)
    xt, yt = x[~aside].astype(float), y[~aside].astype(float)
    mean, scale = xt.mean(0), xt.std(0) + 0.02
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = (xt - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        some = rng.integers(0, len(yt), min(len(yt), 1024))
        h = np.tanh(z[some] @ params[0] + params[1])
        d = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40))) - yt[some]
        back = np.outer(d, params[2]) * (1 - h * h)
        grads = [z[some].T @ back / len(some) + 1e-4 * params[0], back.mean(0), h.T @ d / len(some) + 1e-4 * params[2], np.array([d.mean()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= 0.01 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if aside.any():
        logits, ya = net.logits(x[aside].astype(float)), y[aside].astype(float)
        loss = lambda t: np.logaddexp(0, -np.where(ya > 0, 1, -1) * logits / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _pool(vectors) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = pooled(Tokens(Texts(batch.column("text"))), vectors.value)
                yield pa.RecordBatch.from_pydict({"key": batch.column("_tl_key"), "y": batch.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def learn(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Network:
    """The network, trained on at most so many labelled rows outside the held-out fold."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_tl_key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    marks = marks.where(~held_out(F.col("_tl_key")))
    total = marks.count()
    if total > sample:
        marks = marks.where(F.pmod(F.xxhash64("_tl_key", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * 0.97 * sample / total))
    rows = docs.select(F.col(key).alias("_tl_key"), F.col(text).alias("text")).join(F.broadcast(marks), "_tl_key")
    # a bounded sample of short rows: the network is trained on the driver
    got = rows.mapInArrow(_pool(vectors), T.StructType(fields(key="long", y="int", x="binary"))).collect()
    got.sort(key=lambda r: (r.key, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(-1, 2 * DIM + 1)
    return train(x, np.array([r.y for r in got], np.int64))


def _score(vectors, network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[1]):
                score = network.probabilities(pooled(Tokens(Texts(batch.column(1))), vectors.value).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], [batch.schema.names[0], "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text))
    network = learn(docs, labels, vectors, label, key, text)
    found = docs.select(key, text).mapInArrow(_score(vectors, network), T.StructType([docs.schema[key], *fields(score="double")]))
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
