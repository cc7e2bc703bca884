"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACE_WORD.findall(text or "")


def folded(text):
    return FOLDED_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def repeats(rows, window=13):
    first = {}
    split = [(k, words(t)) for k, t in rows]
    for k, w in split:
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            if k is not None:
                first[g] = min(first.get(g, k), k)
    out = []
    for k, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if k is not None and first[tuple(w[j : j + window])] < k:
                gone |= set(range(j, j + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(rows, items, window=13):
    table = collections.defaultdict(set)
    for i, t in items:
        w = folded(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            table[tuple(w[j : j + n])].add(i)
    sizes = {len(g) for g in table}
    out = []
    for k, t in rows:
        w, hit, found = folded(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in table:
                    hit |= set(range(j, j + n))
                    found |= table[g]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near_classes(rows, threshold=0.8):
    """Class of each row's text: texts are linked if equal, or if their shingle multisets overlap enough."""
    bags = []
    for _, t in rows:
        w = folded(t)
        k = min(5, len(w))
        bags.append(collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            low = sum((bags[a] & bags[b]).values())
            high = sum((bags[a] | bags[b]).values())
            if (rows[a][1] or "") == (rows[b][1] or "") or (high and low >= threshold * high - 1e-9):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {frozenset(g) for g in groups.values()}


def near_classes_by_index(rows, threshold=0.8):
    """As near_classes; only texts that share a shingle are compared, which loses no link."""
    bags, index, parent = [], collections.defaultdict(list), list(range(len(rows)))
    for i, (_, t) in enumerate(rows):
        w = folded(t)
        k = min(5, len(w))
        bags.append(collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter())
        for g in bags[i]:
            index[g].append(i)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    equal = {}
    for a, (_, t) in enumerate(rows):
        b = equal.setdefault(t or "", a)
        parent[root(max(a, b))] = root(min(a, b))
    for a, bag in enumerate(bags):
        shared = collections.Counter()
        for g, n in bag.items():
            for b in index[g]:
                if b < a:
                    shared[b] += min(n, bags[b][g])
        for b, low in shared.items():
            if low >= threshold * (bag.total() + bags[b].total() - low) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {frozenset(g) for g in groups.values()}
