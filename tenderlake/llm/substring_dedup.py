"""Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping blocks of b = 7 words of every document
(words 0-6, 7-13, ...). Any window of 2b - 1 = 13 words holds a whole block, so a
repeated window shows as a rolling 7-word window that meets a block of another document.

1. Documents are dealt into buckets of some megabytes. Each bucket sends, for every
   rolling window of b words, a 32-bit remainder to one of many partitions (which
   stand for further hash bits), once per bucket, marked if it is also a block.
2. A partition answers every bucket with the anchors that are a block somewhere and
   occur in two documents.
3. A bucket extends its anchors to all windows around them and sends those windows'
   80-bit hashes with the smallest document that has each.
4. A partition answers with the smallest document overall; where that is smaller than a
   document's own, its window is a repeat. Covering repeats add up to maximal ones.

A hash occurs once per bucket and partition however often its text is repeated, so a
passage that a third of all documents share is one entry of each bucket. Entries grow
with the words of the input, never with pairs. Buckets are formed from a hash of the
key and are the same on retry. Anchors that collide only add windows to step 3; windows
are equal if 80 bits of two independent hashes agree, so that among 10**12 windows less
than one false pair is to be expected.

Defined results: a null or empty text has no words and keeps none; null keys are never
smaller than others nor have smaller ones, so their rows keep all words and remove
none elsewhere; rows with equal keys do not remove each other's words; texts of any
length are handled whole; an empty table gives an empty one. Helper columns have
names starting with _tl_; all other names in the input are free.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import NON_SPACE, U64, Texts, fields, give_back, mix, total_bytes

#: Text bytes of a bucket; all buckets of a task are worked on one after another.
BUCKET_BYTES = 6 << 20
#: Text bytes whose windows one partition of hashes stands for, about.
PART_BYTES = 6 << 20
NO_KEY = np.iinfo(np.int64).max


def pack(values: np.ndarray) -> bytes:
    """Ascending integers as byte planes of their differences; high planes are zeros and compress away."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(blob: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def by_name(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by both hashes, and where in it new ones start."""
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    if (same & (more[by[1:]] != more[by[:-1]])).any():
        by = np.lexsort((more, h))
        same = (h[by[1:]] == h[by[:-1]]) & (more[by[1:]] == more[by[:-1]])
    return by, np.flatnonzero(np.concatenate([[True], ~same])) if len(by) else np.zeros(0, np.int64)


def located(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of values that occur in the ascending array, and where."""
    if not len(among) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(8, int(len(among) * 8).bit_length())
    # a bit table of scrambled values first: most lookups end there
    maybe = np.zeros(1 << bits, bool)
    maybe[(mix(among) >> U64(64 - bits)).astype(np.int64)] = True
    likely = np.flatnonzero(maybe[(mix(values) >> U64(64 - bits)).astype(np.int64)])
    place = np.minimum(np.searchsorted(among, values[likely]), len(among) - 1)
    same = among[place] == values[likely]
    return likely[same], place[same]


class Bucket:
    """The documents of a bucket as words and window hashes."""

    def __init__(self, rows: pa.Table, text: str, key: str, block: int, window: int):
        self.texts = Texts(rows.column(text))
        self.words = self.texts.words(NON_SPACE)
        self.block, self.window = block, window
        keys = rows.column(key).combine_chunks().cast(pa.int64())
        self.keys = keys.fill_null(NO_KEY).to_numpy(zero_copy_only=False)
        self.owner = self.words.owner()
        lengths = np.diff(self.words.doc)
        n = len(self.owner)
        self.room = np.repeat(self.words.doc[1:], lengths) - np.arange(n)
        self.offset = np.arange(n) - np.repeat(self.words.doc[:-1], lengths)
        self.long = np.repeat(lengths, lengths) >= window
        give_back()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all rolling windows of one block's length."""
        found, _ = self.words.grams(self.block)
        at = np.flatnonzero((self.room >= self.block) & self.long)
        return at, found[at]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and both hashes of the windows that hold a block starting at one of these positions."""
        edge = np.zeros(len(self.owner) + 1, np.int64)
        back = np.minimum(self.window - self.block, self.offset[at])
        np.add.at(edge, at - back, 1)
        edge[at + 1] -= 1
        near = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.room >= self.window))
        found, _ = self.words.grams(self.window)
        return near, found[near], self.second(near)

    def second(self, at: np.ndarray) -> np.ndarray:
        """16 further bits of the windows at these positions, from other multiples of the words' hashes."""
        words = mix(self.words.hashes + U64(0x9E6C63D0876A9A47))
        total = np.zeros(len(at), np.uint64)
        for j in range(self.window):
            total = (total + words[at + j]) * U64(0xC2B2AE3D27D4EB4F)
            total ^= total >> U64(29)
        return (mix(total) >> U64(48)).astype(np.uint16)


def folded(h: np.ndarray, parts: int) -> np.ndarray:
    """(partition, low 32 bits) of a hash in one number."""
    return ((h >> U64(32)) % U64(parts)) << U64(32) | (h & U64(0xFFFFFFFF))


def bucketed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """docs with _tl_bucket, and the number of hash partitions."""
    rows, size = total_bytes(docs, text)
    buckets = max(1, -(-size // BUCKET_BYTES))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(buckets)).cast("int")
    return docs.withColumn("_tl_bucket", spread), max(1, -(-size // PART_BYTES))


def _probe(key: str, text: str, block: int, window: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        docs = Bucket(rows, text, key, block, window)
        at, h = docs.anchors()
        name = folded(h, parts)
        by = np.argsort(name)
        name, at = name[by], at[by]
        heads = np.flatnonzero(np.diff(name, prepend=~name[:1])) if len(name) else np.zeros(0, np.int64)
        out: list[tuple[int, bytes, bytes, bytes]] = []
        if len(heads):
            owner = docs.owner[at]
            flags = np.maximum.reduceat((docs.offset[at] % block == 0).astype(np.uint8), heads)
            flags |= (np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)).astype(np.uint8) << 1
            name = name[heads]
            part = (name >> U64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            low = (name & U64(0xFFFFFFFF)).astype(np.uint32)
            for p in np.flatnonzero(np.diff(cuts)):
                here, mark = low[cuts[p] : cuts[p + 1]], flags[cuts[p] : cuts[p + 1]]
                out.append((int(p), pack(here[mark == 0]), pack(here[mark > 0]), mark[mark > 0].tobytes()))
        bucket = rows.column("_tl_bucket")[0].as_py()
        p, lone, marked, flags = zip(*out) if out else ((), (), (), ())
        return pa.table({"part": pa.array(p, pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "lone": pa.array(lone, pa.binary()), "marked": pa.array(marked, pa.binary()), "flags": pa.array(flags, pa.binary())})

    return run


PROBE = T.StructType(fields(part="int", bucket="int", lone="binary", marked="binary", flags="binary"))


def _meet(rows: pa.Table) -> pa.Table:
    """Per bucket of a partition, its anchors that are a block and occur in two documents."""
    values, marks, sources = [], [], []
    for i, (lone, marked, flags) in enumerate(zip(*(rows.column(c) for c in ("lone", "marked", "flags")))):
        a, b = unpack(lone.as_py(), np.uint32), unpack(marked.as_py(), np.uint32)
        values += [a, b]
        marks += [np.zeros(len(a), np.uint8), np.frombuffer(flags.as_py(), np.uint8)]
        sources.append(np.full(len(a) + len(b), i, np.int32))
    value, mark, source = np.concatenate(values), np.concatenate(marks), np.concatenate(sources)
    by = np.argsort(value, kind="stable")
    value = value[by]
    heads = np.flatnonzero(np.diff(value.astype(np.int64), prepend=-1))
    many = np.diff(np.append(heads, len(value))) > 1
    mark = np.bitwise_or.reduceat(mark[by], heads)
    good = np.repeat((mark & 1 > 0) & (many | (mark & 2 > 0)), np.diff(np.append(heads, len(value))))
    value, source = value[good], source[by][good]
    by = np.argsort(source, kind="stable")
    value, cuts = value[by], np.searchsorted(source[by], np.arange(rows.num_rows + 1))
    out = [pack(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"bucket": rows.column("bucket").combine_chunks(), "part": rows.column("part").combine_chunks(), "found": pa.array(out, pa.binary())})


FOUND = T.StructType(fields(bucket="int", part="int", found="binary"))


def _extend(key: str, text: str, block: int, window: int, parts: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes, bytes, bytes, bytes]] = []
        if rows.num_rows and answers.num_rows:
            docs = Bucket(rows, text, key, block, window)
            at, h = docs.anchors()
            order = np.argsort(answers.column("part").to_numpy())
            known = np.concatenate([unpack(answers.column("found")[int(i)].as_py(), np.uint32).astype(np.uint64) | U64(answers.column("part")[int(i)].as_py()) << U64(32) for i in order])
            hit, _ = located(folded(h, parts), known)
            near, h, more = docs.windows(at[hit])
            by, heads = by_name(h, more)
            h, more, owner = h[by], more[by], docs.owner[near[by]]
            if len(h):
                first = np.minimum.reduceat(docs.keys[owner], heads)
                many = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
                h, more = h[heads], more[heads]
                part = (h % U64(parts)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[by], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    own = by[cuts[p] : cuts[p + 1]]
                    out.append((int(p), pack(h[own]), planes(more[own]), planes(first[own]), many[own].tobytes()))
        bucket = rows.column("_tl_bucket")[0].as_py() if out else 0
        p, hashes, more, first, many = zip(*out) if out else ((), (), (), (), ())
        return pa.table({"part": pa.array(p, pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "hashes": pa.array(hashes, pa.binary()), "more": pa.array(more, pa.binary()), "first": pa.array(first, pa.binary()), "many": pa.array(many, pa.binary())})

    return run


WINDOWS = T.StructType(fields(part="int", bucket="int", hashes="binary", more="binary", first="binary", many="binary"))


def _earliest(rows: pa.Table) -> pa.Table:
    """Per bucket of a partition, its windows that occur in two documents, with the smallest of all."""
    hashes = [unpack(x.as_py(), np.uint64) for x in rows.column("hashes")]
    source = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    h, more = np.concatenate(hashes), np.concatenate([unplanes(x.as_py(), np.uint16) for x in rows.column("more")])
    by, heads = by_name(h, more)
    h, more, source = h[by], more[by], source[by]
    first = np.concatenate([unplanes(x.as_py(), np.int64) for x in rows.column("first")])[by]
    many = np.concatenate([np.frombuffer(x.as_py(), np.bool_) for x in rows.column("many")])[by]
    sizes = np.diff(np.append(heads, len(h)))
    first = np.repeat(np.minimum.reduceat(first, heads), sizes)
    good = np.repeat((sizes > 1) | np.logical_or.reduceat(many, heads), sizes)
    h, more, source, first = h[good], more[good], source[good], first[good]
    by = np.argsort(source, kind="stable")
    cuts = np.searchsorted(source[by], np.arange(rows.num_rows + 1))
    h, more, first = h[by], more[by], first[by]
    pairs = list(zip(cuts[:-1], cuts[1:]))
    return pa.table({"bucket": rows.column("bucket").combine_chunks(), "hashes": pa.array([pack(h[a:b]) for a, b in pairs], pa.binary()), "more": pa.array([planes(more[a:b]) for a, b in pairs], pa.binary()), "first": pa.array([planes(first[a:b]) for a, b in pairs], pa.binary())})


EARLIEST = T.StructType(fields(bucket="int", hashes="binary", more="binary", first="binary"))


def removed_words(docs: Bucket, answers: pa.Table) -> np.ndarray:
    """Which words are covered by a window that starts in a document with a smaller key."""
    gone = np.zeros(len(docs.owner), bool)
    if answers.num_rows:
        h = np.concatenate([unpack(x.as_py(), np.uint64) for x in answers.column("hashes")])
        more = np.concatenate([unplanes(x.as_py(), np.uint16) for x in answers.column("more")])
        first = np.concatenate([unplanes(x.as_py(), np.int64) for x in answers.column("first")])
        by, _ = by_name(h, more)
        h, more, first = h[by], more[by], first[by]
        found, _ = docs.words.grams(docs.window)
        at = np.flatnonzero(docs.room >= docs.window)
        hit, place = located(found[at], h)
        # equal first hashes lie together: go on to the one whose second hash agrees
        second = docs.second(at[hit])
        while True:
            other = np.flatnonzero(more[place] != second)
            other = other[(place[other] + 1 < len(h)) & (h[np.minimum(place[other] + 1, len(h) - 1)] == h[place[other]])]
            if not len(other):
                break
            place[other] += 1
        same = more[place] == second
        hit, place = hit[same], place[same]
        own = docs.keys[docs.owner[at[hit]]]
        at = at[hit[(first[place] < own) & (own != NO_KEY)]]
        edge = np.zeros(len(gone) + 1, np.int32)
        edge[at] += 1
        edge[at + docs.window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
    return gone


def _cut(docs: Bucket, i: int, gone: np.ndarray) -> bytes:
    """Document i without its repeats: each goes up to the next word kept, and all other bytes stay."""
    whole, base = docs.texts.bytes(i), docs.texts.offsets[i]
    a, b = docs.words.doc[i], docs.words.doc[i + 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
    parts, at = [], 0
    for first, after in edges.reshape(-1, 2):
        parts.append(whole[at : docs.words.starts[a + first] - base])
        at = docs.words.starts[a + after] - base if a + after < b else docs.words.ends[b - 1] - base
    return b"".join([*parts, whole[at:]])


def _mark(key: str, text: str, block: int, window: int, digest: bool, columns: list[str]):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        docs = Bucket(rows, text, key, block, window)
        gone = removed_words(docs, answers)
        doc, starts, ends = docs.words.doc, docs.words.starts, docs.words.ends
        n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
        n_removed[np.diff(doc) == 0] = 0
        if digest:
            kept = []
            for i in range(len(docs.texts)):
                whole = docs.texts.bytes(i)
                if n_removed[i]:
                    base = docs.texts.offsets[i]
                    spans = [(starts[w] - base, ends[w] - base) for w in np.flatnonzero(~gone[doc[i] : doc[i + 1]]) + doc[i]]
                    kept.append(b" ".join([whole[a:b] for a, b in spans]))
                else:
                    kept.append(b" ".join(whole.split()))
            return pa.table({key: rows.column(key), "n_words": pa.array(np.diff(doc), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})
        new = rows.column(text).to_pylist()
        for i in np.flatnonzero(n_removed):
            new[i] = _cut(docs, int(i), gone).decode()
        return rows.select(columns).set_column(columns.index(text), text, pa.array(new, pa.string()))

    return run


def _run(docs: DataFrame, key: str, text: str, window: int, digest: bool) -> DataFrame:
    block = (window + 1) // 2
    columns = docs.columns
    if digest:
        docs = docs.select(key, text)
    whole, parts = bucketed(docs, key, text)
    slim = whole.select(key, text, "_tl_bucket") if digest else whole
    probes = slim.groupBy("_tl_bucket").applyInArrow(_probe(key, text, block, window, parts), PROBE)
    anchors = probes.groupBy("part").applyInArrow(_meet, FOUND)
    windows = slim.groupBy("_tl_bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(_extend(key, text, block, window, parts), WINDOWS)
    firsts = windows.groupBy("part").applyInArrow(_earliest, EARLIEST)
    schema = T.StructType([docs.schema[key], *fields(n_words="long", n_removed="long", kept_sha256="string")]) if digest else docs.schema
    return slim.groupBy("_tl_bucket").cogroup(firsts.groupBy("bucket")).applyInArrow(_mark(key, text, block, window, digest, columns), schema)


def repeat_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    return _run(docs, key, text, window, True)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """docs with repeated passages cut out of the text; white space and line breaks between kept words stay as they are."""
    return _run(docs, key, text, window, False)
