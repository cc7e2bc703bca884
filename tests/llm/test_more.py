"""Very long texts through every operator, plain versions of sharding and of the word vectors, and recall on the test tables."""

from __future__ import annotations

import collections
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import decontaminate as dc, near_dedup as nd, quality_classifier as qc, quality_rules as qr, sentencepiece_codec as sp, sharding, substring_dedup as sd, token_counts as tc, token_files as tf, toxicity as tx
from tenderlake.llm.common import Texts, join_counted
from tenderlake.llm.tokens import vocabulary_path

from . import brute

DOC = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["the", "of", "river", "Wort", "x9"]) + str(rng.randrange(5000)) for _ in range(n))
    prose = say(150_000)
    return [(1, prose), (2, prose + " tail"), (3, " " * 300_000), (4, "grumpf " * 150_000), (5, "z" * 300_000), (6, "a b"), (7, None), (8, "é" * 100_000 + "\n" * 50_000)]


def test_long_texts_search(spark, long_rows):
    docs = spark.createDataFrame(long_rows, DOC)
    assert sorted(map(tuple, sd.repeat_digests(docs).collect())) == sorted(brute.repeats(long_rows))
    items = [(1, " ".join(long_rows[0][1].split()[70_000:70_040])), (2, "grumpf grumpf")]
    got = dc.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).drop("item_ids").collect()
    assert sorted(map(tuple, got)) == sorted(brute.contamination(long_rows, items))
    classes = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert classes[1] == classes[2] == 1 and len(set(classes.values())) == 7


def test_long_texts_tokens(spark, long_rows):
    docs = spark.createDataFrame(long_rows, DOC)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in long_rows}
    for r in tf.read_token_files(spark, tf.write_token_files(docs)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*want[r.doc_id], 0]
    lengths = collections.Counter(map(len, want.values()))
    assert {r.n_tokens: r.docs for r in tc.length_histogram(docs).collect()} == lengths
    assert all(r.round_trip for r in sp.round_trips(docs).collect())


def test_long_texts_scores(spark, long_rows):
    docs = spark.createDataFrame(long_rows, DOC)
    labels = spark.createDataFrame([(i, i % 2, int(i == 4)) for i, _ in long_rows], LABELS)
    scores = tx.scored(docs, tx.Lexicon({" grumpf ": 3.0}, (" grumpf river ",), (-3.0, 1.0, 1.0))).collect()
    assert {r.doc_id for r in scores if r.predicted} == {4} and {r.n_terms for r in scores} == {0, 150_000}
    assert len(qc.quality_scores(docs, labels).collect()) == len(long_rows)
    rules = {r.doc_id: r for r in qr.apply_rules(docs).collect()}
    assert rules[1].n_words == 150_000 and rules[4].n_repeat_words == 150_000 and rules[3].n_words == 0 and rules[8].word_chars == 100_000
    shards = sharding.stratified_shards(docs.withColumn("source", F.lit("s"))).collect()
    assert {r.size for r in shards} == {len((t or "").encode()) + 1 for _, t in long_rows}


def test_rules_edges(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None)]
    clash = spark.createDataFrame(rows, DOC).withColumns({"_w": F.lit(1), "source": F.lit("x"), "words": F.lit(2)})
    assert [r.n_words for r in qr.apply_rules(clash).collect()] == [2, 2, 0] and qr.apply_rules(clash.where("false")).count() == 0
    again = qr.apply_rules(clash.withColumns({"kept": F.lit("x"), "n_words": F.lit(-1)}), prefix="m_").first()
    assert (again.kept, again.n_words, again.m_kept) == ("x", -1, False) and qr.apply_rules(clash.withColumn("kept", F.lit("x"))).first().kept is False


def test_sharding_is_the_plain_sort_by_fractional_rank(spark, monkeypatch):
    """Rank each source by the seeded hash, sort by (rank - 1/2) / rows, cut into equal runs."""
    import hashlib

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    rng = random.Random(3)
    rows = [(i, "t" * (i % 5), rng.choices(["hot", "b", "c"], [10, 3, 1])[0]) for i in range(157)]
    lead = {i: int(hashlib.md5(f"17/{i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows}
    by_source = collections.defaultdict(list)
    for i, _, s in rows:
        by_source[s].append(i)
    line = []
    for s, ids in by_source.items():
        for rank, i in enumerate(sorted(ids, key=lead.get)):
            line.append(((2 * rank + 1) / (2.0 * len(ids)), f"={s}", lead[i], i))
    line.sort()
    want, n = {}, len(line)
    for place, (*_, i) in enumerate(line):
        shard = place * 8 // n
        want[i] = (shard, place - (shard * n + 7) // 8)
    got = sharding.stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_contexts_and_pooling_are_plain_sums(monkeypatch):
    monkeypatch.setattr(qc, "PAIRS", 50)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["The", "of", "x9", "A.", "###", "...", "a", "é", "AB", "`"]) for _ in range(rng.randrange(30))) for _ in range(20)] + ["", None]
    tokens = qc.Tokens(Texts(pa.array(texts)))
    found = qc.Contexts()
    found.add(tokens)
    found.add(tokens)
    places, signs = qc.index_vectors(qc.ROWS + qc.SHAPES, 11)
    want = np.zeros((qc.ROWS + qc.SHAPES, qc.DIM), np.int64)
    for i in range(len(tokens.word)):
        for j in range(max(0, i - 2), min(len(tokens.word), i + 3)):
            if i != j and tokens.owner[i] == tokens.owner[j]:
                for here, there in ((tokens.word[i], tokens.word[j]), (qc.ROWS + tokens.shape[i], qc.ROWS + tokens.shape[j])):
                    for p in range(qc.PLACES):
                        want[here, places[there, p]] += 2 * signs[there, p]
    assert np.array_equal(found.sums(), want)
    vectors = np.random.default_rng(2).normal(size=want.shape).astype(np.float32)
    got = qc.pooled(tokens, vectors)
    for d in range(len(texts)):
        here = tokens.owner == d
        plain = np.concatenate([vectors[tokens.word[here]].sum(axis=0), vectors[qc.ROWS + tokens.shape[here]].sum(axis=0)]) / max(1, here.sum())
        assert np.allclose(got[d, :-1], plain, atol=1e-5)


def test_keys_that_repeat_with_other_texts(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    rows = [(5, a), (5, b), (5, a), (6, b + " x"), (8, "alone")]
    got = nd.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    classes = collections.Counter(r.class_id for r in got)
    assert sorted(classes.values()) == [1, 2, 2] and len({r.class_id for r in got if r.doc_id == 5}) == 2
    one = nd.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert len(one) == 3 and len({r.text[:2] for r in one}) == 3


def test_a_large_family_in_open_buckets(spark, monkeypatch):
    """Many near copies of one text, exact copies of it, and texts just below the threshold."""
    monkeypatch.setattr(nd, "BLOCK", 20)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(words)
        for j in range(rng.choice([0, 0, 1, 2, 3, 5, 6])):
            w[rng.randrange(150)] = f"e{i}-{j}"
        rows.append((i, " ".join(w)))
    groups = collections.defaultdict(set)
    for r in nd.near_duplicates(spark.createDataFrame(rows, DOC)).collect():
        groups[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute.near_classes(rows)


def test_join_counted_is_a_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(i, i * 10) for i in range(150)], "k int, w int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(map(tuple, join_counted(left, right, ["k"], counts, "n").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").collect())) and join_counted(left.where("false"), right, ["k"], counts.where("false"), "n").count() == 0


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_recall_on_the_test_tables(spark):
    """Every pair of overlap 0.8 or more, found through an index of all shingles, is in one class; classes are no wider."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = collections.defaultdict(set)
    for r in nd.near_duplicates(docs).collect():
        groups[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute.near_classes_by_index(rows)


def test_verbatim_matches_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x b")], DOC)
    items = spark.createDataFrame([(7, "b c"), (7, None), (8, "")], "item_id long, text string")
    got = collections.Counter((r.key, r.item, r.item_word, r.n_words, r.doc_word) for r in dc.verbatim_matches(docs.withColumn("item", F.lit(1)), items).collect())
    assert got == {(1, "7", 0, 2, 1): 2, (1, "7", 1, 1, 2): 2}
    assert dc.verbatim_matches(docs, items.where("false")).count() == 0 and dc.verbatim_matches(docs.where("false"), items).count() == 0


def test_token_edges(spark):
    histogram = spark.createDataFrame([(3, 2), (5, 1)], "n_tokens long, docs long")
    assert tc.truncated_totals(histogram, []).count() == 0 and tc.quantiles(histogram, []).count() == 0
    clash = spark.createDataFrame([(1, "a b", 9, 9)], "doc_id long, text string, docs int, n_tokens int")
    assert [tuple(r) for r in tc.length_histogram(clash).collect()] == [(2, 1)]
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [5])], "doc_id long, ids array<int>")
    assert {r.doc_id: bool(r.text) for r in sp.decoded(tokens).collect()} == {1: False, 2: False, 3: True}


def test_spaces_by_the_million():
    import sentencepiece

    path = vocabulary_path(sp.MODEL)
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sp.piece_model(path)
    for text in (" " * 300_000, "ab" * 50_000, "x " * 3 + " " * 1000 + "中" * 2000):
        ids, _ = model.encode(Texts(pa.array([text])))
        assert ids.tolist() == library.encode(text)


def test_a_million_toxic_terms():
    made = tx.Lexicon({" bad ": 1.0, " ba": 0.5}, (" bad can ", " so bad ")).automaton()
    assert tx.evidence(tx.fold("bad so bad " * 300_000), made)[1] == 300_000


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tenderlake.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_folder(cluster)


def test_the_sessions_batches_are_left_alone(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], DOC)
    nd.near_duplicates(docs).collect()
    tf.read_token_files(spark, tf.write_token_files(docs)).collect()
    assert spark.conf.get(setting) == before
