"""Benchmark decontamination by suffix arrays over the training text.

Each slice of a partition's documents is a shard with a suffix array of its own. Words
become ids of the test vocabulary; a word that no test item has is 0 and, like the end
of a document, ends every match, so only suffixes that start with a test word are
sorted (any other matches no test suffix at all). Every test suffix is looked up by
binary search in every shard: ranges narrow word by word, which yields its longest
verbatim match and all places of it, and on the way all places of each window.

Shards hold whole documents, so no shuffle is needed: the documents stream past the
test set. The test set is sent to executors in blocks of a checked size, one narrow
pass for each block.

Defined results: null and empty texts have no words and match nothing; rows are judged
one by one, so repeated rows and repeated keys each get their own result; a document of
any length is one shard; empty documents give an empty result, an empty test set hits
nothing. Items without words are left out; an item with a null id counts for hits but
is not listed; rows of one item id are one item. Input columns other than those asked
for are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ALNUM, BROADCAST_BYTES, U64, Texts, fields, gram_hashes, slices

#: Test text of one block, in bytes; the tables made of it take some forty times as much.
BLOCK_BYTES = BROADCAST_BYTES // 40


class TestSet:
    """The items of a block: vocabulary, suffixes and distinct windows."""

    def __init__(self, item_ids: Sequence[str | None], texts: Sequence[str | None], window: int = 13):
        words = Texts(pa.array(texts, pa.large_string())).words(ALNUM, fold=True)
        self.item_ids = list(item_ids)
        self.vocabulary = np.unique(words.hashes)
        self.owner = words.owner()
        lengths = np.diff(words.doc)
        ids = (np.searchsorted(self.vocabulary, words.hashes) + 1).astype(np.int32)
        #: word ids; the zero padding lets a suffix be read past its item's end
        self.ids = np.concatenate([ids, np.zeros(1, np.int32)])
        at = np.arange(len(ids))
        self.room = np.repeat(words.doc[1:], lengths) - at
        first = at == np.repeat(words.doc[:-1], lengths)
        size = np.minimum(window, np.repeat(lengths, lengths))
        starts = np.flatnonzero((self.room >= size) & ((size == window) | first))
        # windows of equal words are one class; sizes differ only for short items
        keys: dict[tuple[int, int], int] = {}
        grams = {n: gram_hashes(words.hashes, n) for n in np.unique(size[starts])}
        self.class_at = np.full(len(ids), -1)
        items: list[set[int]] = []
        representatives = []
        for s in starts:
            key = (int(size[s]), int(grams[size[s]][s]))
            if key not in keys:
                keys[key] = len(items)
                items.append(set())
                representatives.append(s)
            items[keys[key]].add(int(self.owner[s]))
        for k, s in enumerate(representatives):
            self.class_at[s] = k
        self.class_size = np.array([size[s] for s in representatives], np.int64)
        self.class_items = [np.array(sorted(x)) for x in items]
        # a bit table of the vocabulary turns most other words away at once
        self.bits = max(10, int(len(self.vocabulary) * 16).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.vocabulary >> U64(64 - self.bits)).astype(np.int64)] = True

    def translate(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.vocabulary):
            likely = np.flatnonzero(self.maybe[(hashes >> U64(64 - self.bits)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[likely]), len(self.vocabulary) - 1)
            out[likely] = np.where(self.vocabulary[place] == hashes[likely], place + 1, 0)
        return out


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions of non-zero ids, sorted by the ids from there to the next zero.

    Prefix doubling: positions are ranked by 1, 2, 4 ... ids; only ties are sorted again.
    """
    n = len(ids)
    order = np.flatnonzero(ids)
    rank = ids.astype(np.int64)
    order = order[np.argsort(rank[order], kind="stable")]
    # the rank of a group is the place of its first member, plus one
    group = rank[order]
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, len(order)))) + 1
    sizes = np.diff(np.append(heads, len(order)))
    tied = np.repeat(sizes > 1, sizes)
    k = 1
    while tied.any():
        at = np.flatnonzero(tied)
        places = order[at]
        second = rank[np.minimum(places + k, n)]
        key = (rank[places] << 32) | second
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[at] = places
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(np.append(heads, len(key)))
        rank[places] = np.repeat(at[heads], sizes) + 1
        # equal ids up to a zero stay tied for good
        open_ = np.repeat((sizes > 1) & ((key[heads] & 0xFFFFFFFF) > 0), sizes)
        tied = np.zeros(len(order), bool)
        tied[at[open_]] = True
        k *= 2
    return order


def _bound(ids: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """First place in each [low, high) whose id at depth is at least (or above) the wanted one."""
    low, high = low.copy(), high.copy()
    last = len(ids) - 1
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live]) >> 1
        seen = ids[np.minimum(order[mid] + depth, last)]
        before = seen <= want[live] if right else seen < want[live]
        low[live] = np.where(before, mid + 1, low[live])
        high[live] = np.where(before, high[live], mid)


def longest_matches(ids: np.ndarray, order: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Per test suffix: its longest match's length and range in the suffix array; ranges of window classes.

    ids must end with a zero. The ranges are (class, from, to).
    """
    n = len(tests.ids) - 1
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    length = np.zeros(n, np.int64)
    found: list[tuple[int, int, int]] = []
    live, depth = np.arange(n), 0
    while len(live):
        live = live[tests.room[live] > depth]
        want = tests.ids[live + depth]
        a = _bound(ids, order, low[live], high[live], depth, want, False)
        b = _bound(ids, order, a, high[live], depth, want, True)
        some = a < b
        live, a, b = live[some], a[some], b[some]
        depth += 1
        low[live], high[live], length[live] = a, b, depth
        kinds = tests.class_at[live]
        done = np.flatnonzero((kinds >= 0) & (tests.class_size[np.maximum(kinds, 0)] == depth)) if len(tests.class_size) else []
        found += zip(kinds[done].tolist(), a[done].tolist(), b[done].tolist()) if len(done) else []
    return length, low, high, found


class Shard:
    """A slice of documents, their words and suffix array."""

    def __init__(self, texts: Texts, tests: TestSet):
        words = texts.words(ALNUM, fold=True)
        self.doc, self.tests = words.doc, tests
        n = len(words.hashes)
        # one zero after each document
        self.owner = words.owner()
        self.at = np.arange(n) + self.owner
        self.ids = np.zeros(n + len(words.doc), np.int32)
        self.ids[self.at] = tests.translate(words.hashes)
        self.starts = words.doc[:-1] + np.arange(len(words.doc) - 1)
        self.order = suffix_array(self.ids)

    def places(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and word offsets of a range of the suffix array."""
        at = self.order[low:high]
        doc = np.searchsorted(self.starts, at, "right") - 1
        return doc, at - self.starts[doc]

    def windows(self) -> tuple[np.ndarray, list[set[int]]]:
        """Which words are hit, and the items that each document has windows of."""
        *_, ranges = longest_matches(self.ids, self.order, self.tests)
        edge = np.zeros(len(self.ids) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(len(self.doc) - 1)]
        for kind, low, high in ranges:
            at = self.order[low:high]
            edge[at] += 1
            np.subtract.at(edge, at + self.tests.class_size[kind], 1)
            for d in np.unique(np.searchsorted(self.starts, at, "right") - 1):
                items[d].update(self.tests.class_items[kind])
        return np.cumsum(edge)[self.at] > 0, items


def test_blocks(tests: DataFrame, item: str, text: str, window: int, block_bytes: int = BLOCK_BYTES) -> list:
    """The test set as broadcast blocks of a checked size."""
    spark = tests.sparkSession
    rows = tests.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        got = part.orderBy("item", "text").collect()
        out.append(spark.sparkContext.broadcast(TestSet([r.item for r in got], [r.text for r in got], window)))
    return out


def _pass(block, first: bool, last: bool, keep: list[str], text: str, clean_only: bool, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = block.value
        for whole in batches:
            for batch in slices(whole, text):
                shard = Shard(Texts(batch.column(batch.schema.get_field_index(text))), tests)
                hit, items = shard.windows()
                if not first:
                    before = Texts(batch.column(batch.schema.get_field_index("_tl_hit"))).data
                    hit = hit | (before > 0)
                names = [{tests.item_ids[i] for i in x} - {None} for x in items]
                if not first:
                    names = [a | set(b) for a, b in zip(names, batch.column(batch.schema.get_field_index("_tl_items")).to_pylist())]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                if not last:
                    packed = pa.array([hit[a:b].astype(np.uint8).tobytes() for a, b in zip(shard.doc[:-1], shard.doc[1:])], pa.binary())
                    columns += [batch.column(batch.schema.get_field_index(text)), packed, pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "_tl_text", "_tl_hit", "_tl_items"])
                    continue
                n_words = np.diff(shard.doc)
                n_hit = np.bincount(shard.owner[hit], minlength=len(n_words))
                bad = (n_hit > 0) & (100 * n_hit >= percent * n_words)
                if clean_only:
                    yield pa.RecordBatch.from_arrays(columns, keep).filter(pa.array(~bad))
                    continue
                digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
                more = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digests, pa.string()), pa.array(bad), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *more], [*keep, *(f.name for f in DIGEST)])

    return run


DIGEST = fields(n_words="long", n_hit="long", n_items="long", items_sha256="string", contaminated="boolean", item_ids="strings")


def _run(docs: DataFrame, tests: DataFrame, keep: list[str], text: str, item: str, test_text: str, window: int, block_bytes: int, clean_only: bool, percent: int) -> DataFrame:
    blocks = test_blocks(tests, item, test_text, window, block_bytes)
    kept = [docs.schema[c] for c in keep]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        more = ([] if clean_only else DIGEST) if last else fields(_tl_text="string", _tl_hit="binary", _tl_items="strings")
        docs = docs.select(*dict.fromkeys([*keep, text if i == 0 else "_tl_text", *(["_tl_hit", "_tl_items"] if i else [])]))
        docs = docs.mapInArrow(_pass(block, i == 0, last, keep, text if i == 0 else "_tl_text", clean_only, percent), T.StructType([*kept, *more]))
    return docs


def contamination(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", test_text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES, percent: int = 5) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated (so many of a hundred words are hit), item_ids."""
    return _run(docs, tests, [key], text, item, test_text, window, block_bytes, False, percent)


def decontaminated(docs: DataFrame, tests: DataFrame, text: str = "text", item: str = "item_id", test_text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES, percent: int = 0) -> DataFrame:
    """The documents that no test item affects, with all their columns: any hit counts, unless a percentage of words is given."""
    return _run(docs, tests, docs.columns, text, item, test_text, window, block_bytes, True, percent)


MATCH = "key long, item string, item_word int, n_words int, doc_word int"


def verbatim_matches(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", test_text: str = "text", least: int = 1) -> DataFrame:
    """Longest verbatim match of every test suffix, over all shards, with each place of it.

    Rows: key (an integer; others are cast, null if they can't be), item, item_word (offset
    of the suffix), n_words, doc_word. Matches shorter than least words are left out. Null
    and empty texts match nothing; rows and items that repeat give their places each time;
    without documents or items there are no rows. Places of common phrases are many: least
    bounds the length, not the number.
    """
    parts = None
    for block in test_blocks(tests, item, test_text, 13):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            tests = block.value
            first = np.searchsorted(tests.owner, np.arange(len(tests.item_ids)))
            for whole in batches:
                for batch in slices(whole, text):
                    shard = Shard(Texts(batch.column(1)), tests)
                    length, low, high, _ = longest_matches(shard.ids, shard.order, tests)
                    keys = batch.column(0).to_pylist()
                    rows = [
                        (keys[d], tests.item_ids[tests.owner[q]], int(q - first[tests.owner[q]]), int(length[q]), int(w))
                        for q in np.flatnonzero(length >= least)
                        for d, w in zip(*shard.places(low[q], high[q]))
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["key", "item", "item_word", "n_words", "doc_word"])

        one = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, MATCH)
        parts = one if parts is None else parts.unionByName(one)
    best = parts.groupBy("item", "item_word").agg(F.max("n_words").alias("n_words"))
    return parts.join(best, ["item", "item_word", "n_words"]).select("key", "item", "item_word", "n_words", "doc_word")
