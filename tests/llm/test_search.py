"""Operators that look for repeated text, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import decontaminate as dc, near_dedup as nd, substring_dedup as sd
from tenderlake.llm.common import ALNUM, NON_SPACE, Texts
from tenderlake.llm.components import components

from . import brute

DOC = "doc_id long, text string"


def corpus(n=120, seed=5, vocabulary=60):
    rng = random.Random(seed)
    say = lambda k: [rng.choice(["w", "Wörd", "x9", "the", "of", "é"]) + str(rng.randrange(vocabulary)) for _ in range(k)]
    base = [say(rng.choice([3, 8, 12, 13, 14, 40, 200])) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.6 else say(rng.choice([0, 1, 5, 13, 30, 90]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            if w:
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        if rng.random() < 0.3:
            w = say(5) + w + rng.choice(base)[:30]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "***"), (n + 4, "!!! ???")]


def test_word_hashes_follow_the_bytes():
    texts = ["The of THE", "", None, "a\tb  a", "é é", "x" * 5000 + " end"]
    for table, fold, split in ((NON_SPACE, False, brute.words), (ALNUM, True, brute.folded)):
        got = Texts(pa.array(texts)).words(table, fold)
        want = [w for t in texts for w in split(t)]
        assert len(got.hashes) == len(want) and np.diff(got.doc).tolist() == [len(split(t)) for t in texts]
        assert len(set(zip(want, got.hashes.tolist()))) == len(set(want)) == len(set(got.hashes.tolist()))


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(sd, "BUCKET_BYTES", 3000)
        monkeypatch.setattr(sd, "PART_BYTES", 5000)
    rows = corpus()
    got = sd.repeat_digests(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows))


def test_substring_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (None, long), (5, long), (5, long), (7, long), (8, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in sd.repeat_digests(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(-1, 0), (-1, 0), (5, 0), (5, 0), (7, 30), (8, 0)]
    clash = spark.createDataFrame(rows, DOC).withColumns({"n_words": F.lit(1), "part": F.lit(2), "bucket": F.lit(3), "found": F.lit("x")})
    out = sd.without_repeats(clash)
    assert out.columns == clash.columns and {r.doc_id: r.text for r in out.collect()}[7] == ""
    assert sd.repeat_digests(spark.createDataFrame([], DOC)).count() == 0


def test_planes_round_trip():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    assert np.array_equal(sd.unpack(sd.pack(v), np.uint64), v)
    assert np.array_equal(sd.unplanes(sd.planes(v.view(np.int64)), np.int64), v.view(np.int64))
    assert len(sd.unpack(b"", np.uint32)) == 0


ITEMS = "item_id long, text string"


def items():
    rows = corpus(20, 9)
    return [(i, t) for i, t in rows][:22] + [(90, "the of"), (91, ""), (None, corpus(20, 9)[3][1]), (3, "Wörd1 x91")]


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 400])
def test_decontamination(spark, block):
    docs = corpus(60, 9)
    got = dc.contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items(), ITEMS), block_bytes=block).drop("item_ids").collect()
    assert sorted(map(tuple, got)) == sorted(brute.contamination(docs, items()))


def test_decontamination_edges(spark):
    docs = spark.createDataFrame(corpus(30, 9), DOC).withColumns({"n_words": F.lit(0), "item_ids": F.lit("x")})
    empty = spark.createDataFrame([], ITEMS)
    assert dc.contamination(docs, empty).where("n_hit > 0").count() == 0
    assert dc.contamination(docs.where("false"), spark.createDataFrame(items(), ITEMS)).count() == 0
    clean = dc.decontaminated(docs, spark.createDataFrame(items(), ITEMS))
    bad = {r[0] for r in brute.contamination(corpus(30, 9), items()) if r[-1]}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in corpus(30, 9)} - bad


def test_longest_matches(spark):
    docs = [(1, "a b c d e f g"), (2, "x c d e f g h y"), (3, None)]
    got = dc.verbatim_matches(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, "q c d e f g h")], ITEMS), least=3).collect()
    best = {r.item_word: (r.key, r.n_words, r.doc_word) for r in got}
    assert best[1] == (2, 6, 1) and best[4] == (2, 3, 4) and 0 not in best


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ids = np.append(rng.integers(0, 4, rng.integers(0, 60)), 0).astype(np.int32)
        order = dc.suffix_array(ids)
        suffix = lambda i: tuple(ids[i : i + int(np.flatnonzero(ids[i:] == 0)[0])])
        got = [suffix(i) for i in order]
        assert got == sorted(got) and sorted(order.tolist()) == np.flatnonzero(ids).tolist()


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    n, k = 300, 120
    doc, element, weight, truth = [], [], [], []
    for i in range(n):
        e = rng.integers(0, 1 << 48, k, dtype=np.uint64)
        a, b = rng.geometric(0.4, k), rng.geometric(0.4, k)
        b = np.where(rng.random(k) < 0.7, a, b)
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        for side, w in ((0, a), (1, b)):
            doc.append(np.full(k, 2 * i + side))
            element.append(e)
            weight.append(w)
    s = nd.bag_minhash(np.concatenate(doc), np.concatenate(element), np.concatenate(weight), 2 * n, 64)
    found = (s[::2] == s[1::2]).mean(axis=1)
    assert abs(found.mean() - np.mean(truth)) < 0.01


def test_near_duplicates(spark):
    rows = corpus(90, 3)
    got = nd.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    assert len(got) == len(rows) and {frozenset(g) for g in groups.values()} == brute.near_classes(rows)
    assert all(min(g) == c for c, g in groups.items())
    kept = nd.one_of_each(spark.createDataFrame(rows, DOC))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_open_buckets_are_compared(spark, monkeypatch):
    """A chain whose ends are no copies of the middle's other end: stars alone can miss links."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        w = list(words)
        for j in range(i + 1):
            w[(7 * j) % 200] = f"edit{j}"
        rows.append((i, " ".join(w)))
    got = nd.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute.near_classes(rows)


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (4, text), (4, text), (9, text + " more"), (None, "alone here"), (11, None), (12, "")]
    df = spark.createDataFrame(rows, DOC).withColumns({"fp": F.lit("x"), "id": F.lit(1), "n": F.lit(2), "class_id": F.lit(3)})
    got = nd.near_duplicates(df).collect()
    assert len(got) == 8 and {r.class_id for r in got if r.doc_id in (4, 9)} == {4} and {r.class_id for r in got if r.doc_id in (11, 12)} == {11}
    one = nd.one_of_each(df)
    assert one.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect()) == [(False, 4), (False, 11), (True, 0)]
    assert nd.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
