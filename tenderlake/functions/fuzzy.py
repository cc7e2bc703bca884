"""Indel-based similarity, 0 to 100, as Arrow functions.

The longest common subsequence is found bit-parallel: one machine-independent integer
holds a row of the table, so a comparison costs one step per character of a side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql import types as T


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _common(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence with the text that the masks are of."""
    full = (1 << size) - 1
    row = full
    for c in other:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; 100 for two empty texts."""
    total = len(a) + len(b)
    return 100.0 * 2 * _common(_masks(a), len(a), b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of token sets: what both share against what either adds."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, rest_a, rest_b = one & two, one - two, two - one
    if both and not (rest_a and rest_b):
        return 100.0
    shared = " ".join(sorted(both))
    with_a = f"{shared} {' '.join(sorted(rest_a))}".strip()
    with_b = f"{shared} {' '.join(sorted(rest_b))}".strip()
    best = ratio(with_a, with_b)
    if both:
        # the shared part begins either side: the common subsequence is that part
        best = max(best, *(100.0 * 2 * len(shared) / (len(shared) + len(x)) for x in (with_a, with_b)))
    return best


#: Windows that are compared at once.
BLOCK = 1 << 16
#: One window of so many is compared first.
STRIDE = 5


def _common_many(short: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """As _common, for the windows of len(short) that begin at starts of codes; a step serves all windows.

    codes are places of characters in the sorted alphabet of the short text, from 1; 0 is any other.
    """
    m = len(short)
    alphabet = sorted(set(short))
    limbs = -(-m // 64)
    table = np.zeros((limbs, len(alphabet) + 1), dtype=np.uint64)
    for i, c in enumerate(alphabet, 1):
        mask = sum(1 << j for j, x in enumerate(short) if x == c)
        for k in range(limbs):
            table[k, i] = (mask >> (64 * k)) & (2**64 - 1)
    full = [np.uint64(((1 << m) - 1) >> (64 * k) & (2**64 - 1)) for k in range(limbs)]
    rows = [np.full(len(starts), f) for f in full]
    for j in range(m):
        at = codes[starts + j]
        carry = None
        for k in range(limbs):
            row = rows[k]
            hit = row & table[k][at]
            total = row + hit
            if limbs > 1:
                over = total < row
                if carry is not None:
                    total += carry
                    over |= carry & (total == 0)
                carry = over
            rows[k] = (total | (row - hit)) & full[k]
    return m - sum(np.bitwise_count(r).astype(np.int64) for r in rows)


class Aligner:
    """Alignments of many queries with one text; what they share is found once."""

    def __init__(self, text: str):
        self.text = text
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.top = int(self.points.max(initial=0))
        self.places: dict[str, np.ndarray] = {}

    def _found(self, piece: str) -> np.ndarray:
        if piece not in self.places:
            out, at = [], self.text.find(piece)
            while at >= 0:
                out.append(at)
                at = self.text.find(piece, at + 1)
            self.places[piece] = np.array(out, dtype=np.int64)
        return self.places[piece]

    def _starts(self, short: str, floor: float) -> np.ndarray:
        """Starts of all windows that can reach the floor, in order.

        One that does is at most so many insertions and deletions away; of one piece more, a piece
        stands in it unchanged, and no further than those from its own place.
        """
        m, n = len(short), len(self.text)
        edits = int(2 * m * (1 - floor / 100) + 1e-6)
        pieces = edits + 1
        if pieces * 2 > m:
            return np.arange(1 - m, n)
        cuts = [m * i // pieces for i in range(pieces + 1)]
        near = np.zeros(m + n + 1, dtype=np.int32)
        for a, b in zip(cuts, cuts[1:]):
            begin = self._found(short[a:b]) - a + m - 1
            np.add.at(near, np.clip(begin - edits, 0, m + n), 1)
            np.add.at(near, np.clip(begin + edits + 1, 0, m + n), -1)
        return np.flatnonzero(np.cumsum(near)[: m + n - 1] > 0) + 1 - m

    def best(self, query: str, floor: float = 0.0) -> tuple[float, int, int] | None:
        """As partial_alignment, of a query that is no longer than the text."""
        m, n = len(query), len(self.text)
        starts = self._starts(query, floor)
        if not len(starts):
            return None
        known = np.zeros(self.top + 1, dtype=np.int64)
        for i, c in enumerate(sorted(set(query)), 1):
            if ord(c) <= self.top:
                known[ord(c)] = i
        codes = np.zeros(n + 2 * (m - 1), dtype=np.int64)
        codes[m - 1 : m - 1 + n] = known[self.points]
        ends = m + np.minimum(starts + m, n) - np.maximum(starts, 0)
        common = lambda at: np.concatenate([_common_many(query, codes, at[k : k + BLOCK] + m - 1) for k in range(0, len(at), BLOCK)])
        if len(starts) > 16 * STRIDE:
            # a step changes the common part by one at most: a few windows bound those around them
            tried = np.arange(STRIDE // 2, len(starts), STRIDE)
            some = common(starts[tried])
            by = np.minimum(np.arange(len(starts)) // STRIDE, len(tried) - 1)
            least = max(floor, float(np.max(200.0 * some / ends[tried])))
            kept = 200.0 * (some[by] + np.abs(starts - starts[tried][by])) / ends >= least
            starts, ends = starts[kept], ends[kept]
        if not len(starts):
            return None
        scores = 200.0 * common(starts) / ends
        top = int(np.argmax(scores))
        low = int(starts[top])
        return (float(scores[top]), max(low, 0), min(low + m, n)) if scores[top] >= floor else None


def partial_alignment(query: str, text: str, floor: float = 0.0, aligner: Aligner | None = None) -> tuple[float, int, int] | None:
    """Best ratio of the shorter text against windows of the longer: (score, start, end) in text.

    Windows have the shorter one's length, or less at the ends; the first best one counts.
    None where nothing reaches the floor. aligner is one of the text, where many queries meet it.
    """
    if not query or not text:
        return None
    if len(query) > len(text):
        found = Aligner(query).best(text, floor)
        return found and (found[0], 0, len(text))
    return (aligner or Aligner(text)).best(query, floor)


@pandas_udf(T.DoubleType())
def token_set_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


ALIGNMENT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def aligned(floor: float = 0.0):
    """A function of (query, text): their best alignment; nulls where either is null or empty, or nothing reaches the floor."""

    @pandas_udf(ALIGNMENT)
    def align(query: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [partial_alignment(q, t, floor) if q and t else None for q, t in zip(query, text)]
        return pd.DataFrame([r or (None, None, None) for r in rows], columns=["score", "start", "end"]).astype({"score": "float64", "start": "Int32", "end": "Int32"})

    return align
