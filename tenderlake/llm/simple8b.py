"""Simple-8b: unsigned integers packed into 64-bit words, a 4-bit selector in each.

A selector says how many values a word holds and in how many bits each. Values above 60
bits are escapes: the word marks the place, the value follows the block's words, in
order. Values come in blocks; each block starts a word and its offset is kept, so blocks
can be decoded alone, and all words of many blocks at once.
"""

from __future__ import annotations

import numpy as np

from .common import U64

#: (values, bits) by selector; selector 0 is an escape.
SELECTORS = [(1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([c for c, _ in SELECTORS], np.int64)
BITS = [b for _, b in SELECTORS]
BLOCK = 1024


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits of the narrowest selector that holds each value; 61 for an escape."""
    widths = sorted(set(BITS))
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values]
    return np.array([*widths, 61], np.uint8)[np.searchsorted(np.array([(1 << b) - 1 for b in widths], np.uint64), values)]


_SMALL = np.array([next(b for b in sorted(set(BITS)) if v < 1 << b) for v in range(1 << 16)], np.uint8)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): blocks of so many values; block i has words offsets[i] to offsets[i + 1] - 1."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # one row per block; what is beyond a block's end fits no selector
    need = np.full((-(-n // block), block), 255, np.uint8)
    need.reshape(-1)[:n] = _lengths(values)
    # the selector with most values that fit from each place on: sliding maxima by doubling
    best = np.full(need.shape, 15, np.uint8)
    best[need == 61] = 0
    tables = [need]
    while (1 << len(tables)) <= min(120, block):
        half, last = 1 << (len(tables) - 1), tables[-1]
        longer = np.full_like(last, 255)
        np.maximum(last[:, :-half], last[:, half:], out=longer[:, :-half])
        tables.append(longer)
    for s in range(14, 0, -1):
        c, b = SELECTORS[s]
        if c <= block:
            k, room = c.bit_length() - 1, block - c + 1
            most = np.maximum(tables[k][:, :room], tables[k][:, c - (1 << k) : c - (1 << k) + room])
            np.copyto(best[:, :room], s, where=most <= b)
    best = best.reshape(-1)
    # all blocks step from word to word together
    at = np.arange(0, n, block)
    ends = np.minimum(at + block, n)
    owner, starts = [], []
    live = np.arange(len(at))
    while len(live):
        owner.append(live)
        starts.append(at[live])
        at[live] += COUNTS[best[at[live]]]
        live = live[at[live] < ends[live]]
    owner, starts = np.concatenate(owner), np.concatenate(starts)
    by = np.argsort(starts, kind="stable")
    owner, starts = owner[by], starts[by]
    chosen = best[starts]
    words = chosen.astype(np.uint64) << U64(60)
    for s in np.unique(chosen):
        c, b = SELECTORS[s]
        if b:
            here = np.flatnonzero(chosen == s)
            shifts = np.arange(c, dtype=np.uint64) * U64(b)
            words[here] |= np.bitwise_or.reduce(values[starts[here][:, None] + np.arange(c)] << shifts, axis=1)
    offsets = np.searchsorted(owner, np.arange(len(ends) + 1))
    escaped = np.flatnonzero(chosen == 0)
    if len(escaped):
        # raw values go behind the words of their block
        where = offsets[owner[escaped] + 1]
        words = np.insert(words, where, values[starts[escaped]])
        offsets = offsets + np.searchsorted(owner[escaped], np.arange(len(ends) + 1))
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of all blocks."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> U64(60)).astype(np.int64)
    count = COUNTS[selector]
    # words behind those that fill the block are raw values: their counts don't matter
    sizes = np.minimum(block, n - np.arange(len(offsets) - 1) * block)
    place = np.cumsum(count) - count
    place = place - np.repeat(place[np.minimum(offsets[:-1], len(words) - 1)], np.diff(offsets))
    real = place < np.repeat(sizes, np.diff(offsets))
    start = place + np.repeat(np.arange(len(sizes)) * block, np.diff(offsets))
    if (~real).any():
        # a raw word can hide how many words a block has: find each block's last real word one after another
        for i in np.flatnonzero(np.add.reduceat(~real, offsets[:-1])):
            real[offsets[i] + int(np.argmin(real[offsets[i] : offsets[i + 1]])) : offsets[i + 1]] = False
    for s in np.unique(selector[real]):
        here = np.flatnonzero(real & (selector == s))
        c, b = SELECTORS[s]
        if s == 0:
            raw = np.flatnonzero(~real)
            out[start[here]] = words[raw]
        elif b:
            shifts = np.arange(c, dtype=np.uint64) * U64(b)
            out[start[here][:, None] + np.arange(c)] = (words[here][:, None] >> shifts) & ((U64(1) << U64(b)) - U64(1))
    return out
