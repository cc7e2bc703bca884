"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Text is taken as the model's normaliser leaves it (identity, a space put in front, white
space kept), spaces as U+2581. It falls into words that no piece crosses: before each
run of spaces, and around characters that only occur alone. Distinct words of equal
length advance together, character by character: the hashes of all substrings that end
there probe the sorted keys of the pieces, and a maximum over the possible last pieces
stores backpointers, one column per position. A character without a piece is written as
byte pieces.

What is maximised follows the model's kind. In a unigram model it is the sum of scores.
A model of the merging kind has ranks for scores, and their sum would not give the ids
that the model stands for; there a piece may follow another only if merging by rank
would leave the two apart, which exactly one segmentation does throughout, and the
maximum over (follows, does not) finds it. Words with pieces of tied ranks (runs of
spaces), and words above LONG characters, which would advance alone, are merged step by
step instead, with a heap. Either way the ids are the library's own.

Decoding joins the pieces' bytes, and drops the space in front: texts come back as they
were, but for U+2581 itself, which comes back as a space as in the library.

Defined results: null and empty texts have no ids and come back empty; repeated rows
give equal rows; texts of any length are encoded whole; an empty table gives an empty
one. Only key and text are read, so further columns can have any name.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U64, Texts, _GRAM, _power_table, fields, mix, slices
from .tokens import WordCache, code_points, vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = 0x2581
#: Longer words of a merging model are not looked at by the Viterbi, which gains by equal lengths.
LONG = 512


def point_values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + U64(0x5851F42D4C957F2D)) | U64(1)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            at += size
            yield tag >> 3, data[at - size : at]


def merges(path: str) -> bool:
    """Whether the model file is of the merging kind (trainer_spec.model_type is BPE)."""
    with open(path, "rb") as f:
        trainer = next((v for k, v in _fields(f.read()) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), 1) == 2


NONE, UNKNOWN = -1, -2


class PieceModel(WordCache):
    """The pieces of a model: sorted hash keys, scores, ids and bytes.

    Pieces are numbered by rank: from the greatest score down.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self._tables(names, {i: model.get_score(i) for i in normal}, {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}, model.unk_id(), merges(path))
        super().__init__()

    def _tables(self, names: list[str], scores: dict[int, float], byte_ids: dict[int, int], unknown: int, by_merges: bool) -> None:
        self.longest = max((len(names[i]) for i in scores), default=1)
        self.by_merges = by_merges
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        self.names = [names[i] for i in ranked]
        self.rank = {name: r for r, name in enumerate(self.names)}
        self.ids = np.array(ranked, np.int64)
        self.scores = np.array([scores[i] for i in ranked], float)
        points = [np.frombuffer(name.encode("utf-32-le"), np.uint32) for name in self.names]
        self.length = np.array([len(p) for p in points], np.int64)
        up, _ = _power_table(self.longest + 1)
        self.sums = np.array([(point_values(p) * up[: len(p)]).sum(dtype=np.uint64) for p in points], np.uint64)
        keys = mix(self.sums + self.length.astype(np.uint64) * _GRAM[1])
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        assert (np.diff(self.keys) > 0).all(), "pieces whose hashes collide"
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True
        self.penalty = (self.scores.min() if len(scores) else 0.0) - 10.0
        self.byte_ids = np.array([byte_ids.get(b, unknown) for b in range(256)], np.int64)
        if by_merges:
            self._merge_tables()
        # pieces as bytes, for decoding
        out = [names[i].replace("▁", " ").encode() if i in scores else b"" for i in range(len(names))]
        for b, i in byte_ids.items():
            out[i] = bytes([b])
        self.sizes = np.array([len(x) for x in out], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        # characters of longer pieces tie words together; all others are words of their own
        joined = sorted({ord(c) for name in self.names if len(name) > 1 for c in name})
        self.joining = np.zeros(0x110000, bool)
        self.joining[joined] = True
        self.split_by_space = not any("▁" in name.lstrip("▁") for name in self.names)

    def merged(self, word: str) -> list[str]:
        """The word's symbols after merging the best adjacent pair, the first of equals, again and again."""
        parts: list[str | None] = list(word)
        n, rank, score = len(parts), self.rank, self.scores.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[r], i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, name = heapq.heappop(heap)
            j = after[i]
            # a pair that an earlier merge took apart is passed over
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(name) or parts[i] + parts[j] != name:
                continue
            parts[i], parts[j] = name, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(name + parts[k])) is not None:
                    heapq.heappush(heap, (-score[r], i, name + parts[k]))
            if (k := before[i]) >= 0 and (r := rank.get(parts[k] + name)) is not None:
                heapq.heappush(heap, (-score[r], k, parts[k] + name))
        return [p for p in parts if p is not None]

    def _merge_tables(self) -> None:
        """For each piece the pair that merging makes it of last; single characters stand for themselves."""
        n = len(self.names)
        self.left, self.right = np.arange(n), np.arange(n)
        self.usable = np.ones(n, bool)
        for r, name in enumerate(self.names):
            parts = list(name)
            while len(parts) > 2:
                found = [(k, i) for i in range(len(parts) - 1) if (k := self.rank.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2 and all(p in self.rank for p in parts):
                self.left[r], self.right[r] = self.rank[parts[0]], self.rank[parts[1]]
            elif len(parts) > 1:
                self.usable[r] = False
        # undoing goes from the latest merge back: characters come before all merges
        self.order = np.where(self.length > 1, np.arange(n) + 1, 0)
        values, counts = np.unique(self.scores, return_counts=True)
        self.tied = np.isin(self.scores, values[counts > 1]) & (self.length > 1)
        self.pairs = np.zeros(1 << 20, np.int64)

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves two adjacent pieces as they are."""
        n = len(self.names)
        name = first * n + second + 1
        slot = (mix(name.astype(np.uint64)) >> U64(44)).astype(np.int64)
        kept = self.pairs[slot]
        out = kept > 0
        lost = np.flatnonzero(np.abs(kept) != name)
        if len(lost):
            out[lost] = self._apart(first[lost], second[lost])
            self.pairs[slot[lost]] = np.where(out[lost], name[lost], -name[lost])
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes merges from the latest on, looking for a merge across the border that would have come first.

        limit is twice the order of the merge that takes one of the two away, one more if
        it lies on the right: of equal merges the left one comes first.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        up, _ = _power_table(2 * self.longest + 1)
        while len(live):
            size = self.length[a] + self.length[b]
            keys = mix(self.sums[a] + self.sums[b] * up[self.length[a]] + size.astype(np.uint64) * _GRAM[1])
            across = self.lookup(keys)
            broken = (across >= 0) & (2 * self.order[across] < limit)
            out[live[broken]] = False
            # the later of the two is undone; of two characters nothing is left to undo
            left = self.order[a] > self.order[b]
            limit = np.where(left, 2 * self.order[a], 2 * self.order[b] + 1)
            go = ~broken & ((self.order[a] > 0) | (self.order[b] > 0))
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return out

    def values(self, points: np.ndarray) -> np.ndarray:
        return point_values(points)

    def cuts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        joining = self.joining[points]
        starts = first | ~joining
        starts[1:] |= ~joining[:-1]
        if self.split_by_space:
            space = points == SPACE
            starts[1:] |= space[1:] & ~space[:-1]
        return starts

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Pieces of keys, NONE where there is none."""
        out = np.full(keys.shape, NONE, np.int64)
        likely = np.nonzero(self.maybe[(keys >> U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, keys[likely]), len(self.keys) - 1)
        out[likely] = np.where(self.keys[place] == keys[likely], self.by_key[place], NONE)
        return out

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backpointers of words of equal length, a row each: the last piece's length and number (UNKNOWN: a bare
        character) per end; and which words hold pieces of tied ranks."""
        k, n = words.shape
        up, down = _power_table(n + 1)
        sums = np.zeros((k, n + 1), np.uint64)
        np.cumsum(point_values(words) * up[:n], axis=1, out=sums[:, 1:])
        best = np.zeros((k, n + 1))
        length = np.zeros((k, n + 1), np.int32)
        piece = np.full((k, n + 1), UNKNOWN, np.int64)
        tied = np.zeros(k, bool)
        rows = np.arange(k)
        for end in range(1, n + 1):
            sizes = np.arange(1, min(self.longest, end) + 1)
            at = end - sizes
            found = self.lookup(mix((sums[:, end, None] - sums[:, at]) * down[at] + sizes.astype(np.uint64) * _GRAM[1]))
            if self.by_merges:
                r, c = np.nonzero(found >= 0)
                here = found[r, c]
                tied[r[self.tied[here]]] = True
                good = self.usable[here]
                before = piece[r, at[c]]
                check = np.flatnonzero(good & (before >= 0))
                good[check] = self.apart(before[check], here[check])
                score = np.full(found.shape, -np.inf)
                score[r, c] = np.where(good, 0.0, -np.inf)
                score[found[:, 0] == NONE, 0] = 0.0
            else:
                score = np.where(found >= 0, self.scores[found], -np.inf)
                score[:, 0] = np.where(found[:, 0] >= 0, score[:, 0], self.penalty)
            total = best[:, at] + score
            pick = total.argmax(axis=1)
            best[:, end] = total[rows, pick]
            length[:, end] = sizes[pick]
            piece[:, end] = np.where(found[rows, pick] == NONE, UNKNOWN, found[rows, pick])
        return length, piece, tied

    def word_ids(self, source: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = ends - starts
        parts: list[np.ndarray] = []
        where, counted, used = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        def step_by_step(rows: np.ndarray) -> None:
            nonlocal used
            for row in rows:
                symbols = self.merged(source[starts[row] : ends[row]].tobytes().decode("utf-32-le"))
                parts.append(np.concatenate([[self.ids[self.rank[x]]] if x in self.rank else self.byte_ids[np.frombuffer(x.encode(), np.uint8)] for x in symbols]))
                where[row], counted[row] = used, len(parts[-1])
                used += len(parts[-1])

        if self.by_merges:
            step_by_step(np.flatnonzero(sizes > LONG))
        for n in np.unique(sizes[sizes <= LONG] if self.by_merges else sizes):
            group = np.flatnonzero(sizes == n)
            for low in range(0, len(group), max(1, 200_000 // int(n))):
                some = group[low : low + max(1, 200_000 // int(n))]
                words = source[starts[some][:, None] + np.arange(n)]
                length, piece, tied = self.viterbi(words)
                # all words walk back together
                end, live = np.full(len(some), n), np.arange(len(some))
                chain: list[list[np.ndarray]] = [[], [], []]
                while len(live):
                    size = length[live, end[live]]
                    chain[0].append(live)
                    chain[1].append(end[live] - size)
                    chain[2].append(piece[live, end[live]])
                    end[live] -= size
                    live = live[end[live] > 0]
                who, at, what = (np.concatenate(x) for x in chain)
                by = np.lexsort((at, who))
                who, at, what = who[by], at[by], what[by]
                ids = np.where(what >= 0, self.ids[what], -1)
                counts = np.ones(len(ids), np.int64)
                bare = np.flatnonzero(what < 0)
                spelt = {int(i): self.byte_ids[np.frombuffer(chr(words[who[i], at[i]]).encode(), np.uint8)] for i in bare}
                for i, x in spelt.items():
                    counts[i] = len(x)
                flat = np.repeat(ids, counts)
                places = np.cumsum(counts) - counts
                for i, x in spelt.items():
                    flat[places[i] : places[i] + len(x)] = x
                counted[some] = np.bincount(who, weights=counts, minlength=len(some)).astype(np.int64)
                where[some] = used + np.cumsum(counted[some]) - counted[some]
                parts.append(flat)
                used += len(flat)
                step_by_step(some[np.flatnonzero(tied)])
        return np.concatenate(parts).astype(np.uint32), where, counted

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        _, points, doc = code_points(texts)
        points = np.where(points == 0x20, SPACE, points).astype(np.uint32)
        some = np.diff(doc) > 0
        # the space in front of each text
        points = np.insert(points, doc[:-1][some], SPACE)
        doc = doc + np.concatenate([[0], np.cumsum(some)])
        return self.known(points, points, doc)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids, counts[i] of them each."""
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        data = self.bytes[np.arange(total[-1] if len(total) else 0) + np.repeat(self.offsets[ids] - (total - sizes), sizes)]
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        starts = np.concatenate([[0], ends[:-1]])
        out = []
        for a, b in zip(starts, ends):
            text = data[a:b].tobytes().decode(errors="replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The worker's tables of this model file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encode(path: str, text: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for whole in batches:
            for batch in slices(whole, text):
                texts = Texts(batch.column(1))
                ids, counts = model.encode(texts)
                ends = np.cumsum(counts)
                if not digest:
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists], [batch.schema.names[0], "ids"])
                    continue
                data = memoryview(ids.astype("<u4")).cast("B")
                back = model.decode(ids, counts)
                same = [b.encode() == texts.bytes(i) for i, b in enumerate(back)]
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends - counts, ends)]
                bytes_ = np.add.reduceat(np.append(np.isin(ids, model.byte_ids), False).astype(np.int64), ends - counts) * (counts > 0) if len(counts) else counts
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(bytes_, pa.int64()), pa.array(crc, pa.int64()), pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()), pa.array(same)], [batch.schema.names[0], "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return run


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per document: key and ids."""
    return docs.select(key, text).mapInArrow(_encode(model or vocabulary_path(MODEL), text, False), T.StructType([docs.schema[key], *fields(ids="ints")]))


def round_trips(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per document: key, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, round_trip (the text came back)."""
    out = fields(n_pieces="long", n_byte_pieces="long", ids_crc32="long", decoded_crc32="long", round_trip="boolean")
    return docs.select(key, text).mapInArrow(_encode(model or vocabulary_path(MODEL), text, True), T.StructType([docs.schema[key], *out]))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(1)
            counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode(ids, counts), pa.string())], [batch.schema.names[0], "text"])

    return run


def decoded(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """Per row: key and the text of its ids (null ids: empty)."""
    return tokens.select(key, ids).mapInArrow(_decode(model or vocabulary_path(MODEL)), T.StructType([tokens.schema[key], *fields(text="string")]))
