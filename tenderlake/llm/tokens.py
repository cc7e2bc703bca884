"""Fast exact use of a byte-level BPE tokenizer of the tokenizers library.

The library encodes each distinct pre-token once per worker; texts are cut into
pre-tokens and put together from the known ones with array operations. The cut follows
the byte-level pre-tokenizer's rule: contractions, runs of letters, of digits and of
other characters with one space before them, and white space. It is done here for texts
of code points below 0x3000 without strings of added tokens (<|endoftext|>), and left to
the library, text by text, for all others. Ids are those of the library as it is loaded.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import U64, Texts, _GRAM, _power_table, mix

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 0x3000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: White space below LIMIT.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
_SLOTS = 1 << 20
_POOL = 1 << 23


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LIMIT)], np.uint8)
    out[BLANKS] = SPACE
    return out


def pretoken_starts(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; first marks the starts of texts."""
    n = len(points)
    kind = classes[points]
    space = kind == SPACE
    before, after = np.empty(n, np.uint8), np.empty(n, bool)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    # a blank before a word goes with it (if a plain space) or stands alone
    after[-1], after[:-1] = False, ~space[1:] & ~first[1:]
    joined = np.zeros(n, bool)
    joined[1:] = points[:-1] == 0x20
    starts = first | (~space & (kind != before) & ~(joined & ~first)) | (space & ((before != SPACE) | after))
    quotes = np.flatnonzero(starts & (points == 0x27))
    if len(quotes):
        def at(k: int) -> np.ndarray:
            """Points k after the quotes, 0 beyond the end of a text."""
            where = np.minimum(quotes + k, n - 1)
            got = np.where(quotes + k < n, points[where], 0)
            for j in range(1, k + 1):
                got = np.where((quotes + j < n) & first[np.minimum(quotes + j, n - 1)], 0, got)
            return got

        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((short, 2), (long, 3)):
            here = quotes[chosen]
            starts[here + 1] = False
            rest = here + size
            starts[rest[rest < n]] = True
    return starts


class WordCache:
    """Ids of texts put together from the ids of their words, each of which is encoded once.

    A direct-mapped table from word hashes to places in a pool of ids; a collision only
    replaces an older entry, and a full pool starts anew. Subclasses cut texts into words
    that are independent of each other, and encode distinct words.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(_SLOTS, np.uint64)
        self.place = np.zeros(_SLOTS, np.int64)
        self.pool = np.zeros(_POOL, np.uint32)
        self.used = 0

    def values(self, points: np.ndarray) -> np.ndarray:
        """A 64-bit number for each code point."""
        raise NotImplementedError

    def cuts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start; first marks the starts of texts."""
        raise NotImplementedError

    def word_ids(self, source, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words of the source, where each word's ids start, and how many it has."""
        raise NotImplementedError

    def known(self, source, points: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts from doc[i] to doc[i + 1] - 1, and how many each has."""
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(doc) - 1, np.int64)
        first = np.zeros(len(points), bool)
        first[doc[:-1][doc[:-1] < len(points)]] = True
        starts = np.flatnonzero(self.cuts(points, first))
        ends = np.append(starts[1:], len(points))
        hashes = self._hash(points, starts, ends)
        slot = (hashes & U64(_SLOTS - 1)).astype(np.int64)
        place = self.place[slot]
        lost = np.flatnonzero(self.hashes[slot] != hashes)
        if len(lost):
            by = lost[np.argsort(hashes[lost], kind="stable")]
            heads = np.flatnonzero(np.diff(hashes[by], prepend=~hashes[by[:1]]))
            new = by[heads]
            ids, where, sizes = self.word_ids(source, starts[new], ends[new])
            if self.used + len(ids) > len(self.pool):
                self._forget()
                if len(ids) > len(self.pool) // 2:
                    self.pool = np.zeros(4 * len(ids), np.uint32)
                return self.known(source, points, doc)
            self.pool[self.used : self.used + len(ids)] = ids
            packed = (self.used + where) << 24 | sizes
            self.used += len(ids)
            place[by] = np.repeat(packed, np.diff(np.append(heads, len(by))))
            self.hashes[slot[new]] = hashes[new]
            self.place[slot[new]] = packed
        sizes = place & 0xFFFFFF
        total = np.cumsum(sizes)
        out = self.pool[np.arange(total[-1]) + np.repeat((place >> 24) - (total - sizes), sizes)]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, doc)]
        return out, np.diff(upto)

    def _hash(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + (1 << 18), "right")))
            high = ends[to - 1]
            up, down = _power_table(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.values(points[low:high]) * up[: high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _GRAM[0]) | U64(1)
            at = to
        return out


def code_points(texts: Texts) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points, and where texts start in them."""
    strings = texts.data.tobytes().decode()
    begins = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    return strings, np.frombuffer(strings.encode("utf-32-le"), np.uint32), begins[texts.offsets]


class Encoder(WordCache):
    """Ids of texts by a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # words come from texts without such strings, and must not make one side by side
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        # a piece is spelt with one character per byte
        self.bytes = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], np.int64)
        self.numbers = np.random.default_rng(5).integers(0, 1 << 63, LIMIT, dtype=np.uint64) * U64(2) + U64(1)
        super().__init__()

    def values(self, points: np.ndarray) -> np.ndarray:
        return self.numbers[points]

    def cuts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        return pretoken_starts(points, self.classes, first)

    def word_ids(self, source: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens that a space starts are encoded many in one go, and told apart by their bytes; others one by one."""
        words = [source[a:b] for a, b in zip(starts, ends)]
        plain = [len(w) > 1 and w[0] == " " and self.classes[ord(w[1])] != SPACE for w in words]
        joined, rest = np.flatnonzero(plain), np.flatnonzero(~np.array(plain, bool))
        runs = ["".join([words[i] for i in joined[low : low + 2000]]) for low in range(0, len(joined), 2000)]
        parts = [np.array(got.ids, np.uint32) for got in self.plain.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        cuts = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(words[i].encode()) for i in joined])) + 1
        singles = [got.ids for got in self.plain.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        sizes = np.zeros(len(words), np.int64)
        sizes[joined] = np.diff(cuts, prepend=0)
        sizes[rest] = [len(x) for x in singles]
        where = np.zeros(len(words), np.int64)
        where[joined] = np.cumsum(sizes[joined]) - sizes[joined]
        where[rest] = len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
        return np.concatenate([ids, np.array([i for x in singles for i in x], np.uint32)]), where, sizes

    def _added_at(self, strings: str) -> np.ndarray:
        """Where strings of added tokens start."""
        found = []
        for token in self.added:
            at = strings.find(token)
            while at >= 0:
                found.append(at)
                at = strings.find(token, at + 1)
        return np.array(found, np.int64)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        strings, points, doc = code_points(texts)
        rare = np.unique(np.searchsorted(doc, np.concatenate([np.flatnonzero(points >= LIMIT), self._added_at(strings)]), "right") - 1)
        parts, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for i in [*rare.tolist(), len(doc) - 1]:
            if i > at:
                ids, n = self.known(strings[doc[at] : doc[i]], points[doc[at] : doc[i]], doc[at : i + 1] - doc[at])
                parts.append(ids)
                counts.append(n)
            if i < len(doc) - 1:
                ids = np.array(self.library.encode(strings[doc[i] : doc[i + 1]], add_special_tokens=False).ids, np.uint32)
                parts.append(ids)
                counts.append(np.array([len(ids)]))
            at = i + 1
        return np.concatenate(parts), np.concatenate(counts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
