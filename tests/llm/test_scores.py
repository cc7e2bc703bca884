"""Scoring, sharding and token operators."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderlake.llm import quality_classifier as qc, quality_rules as qr, sentencepiece_codec as sp, sharding, simple8b, token_counts as tc, token_files as tf, toxicity as tx
from tenderlake.llm.common import Texts
from tenderlake.llm.tokens import encoder, vocabulary_path

from . import brute

DOC = "doc_id long, text string"
RULED = ["", None, "one two", "a b c a b c a b c d", "x\n\nx\n \nx y\r\nx y", "* # the of <b>|&%$", "a a a a a", "é  ü\x0bthe.\tof, THE", "the " * 60, "the cat and of " * 20, " ".join(f"word{i} the of." for i in range(30))]


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(RULED)), DOC)
    rows = {r.doc_id: r for r in qr.apply_rules(df.withColumn("source", F.lit("x"))).collect()}
    for i, t in enumerate(RULED):
        w = brute.words(t)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        many = Counter(grams)
        again = {j + k for j, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        stops = sum((x[:-1] if x[-1] in ".,;:" and x[:-1] in qr.STOP_WORDS else x) in qr.STOP_WORDS for x in w)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_stop_words) == (len(w), sum(map(len, w)), sum(c in qr.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(again), stops), t
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rows[len(RULED) - 1].kept and not rows[8].kept
    plan = qr.apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("shards", [1, 8])
def test_sharding(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    rows = [(i, rng.choice(["é" * 3, "", None, "same"]), rng.choices(["hot", "b", None, "-", "c"], [10, 3, 1, 1, 1])[0]) for i in range(211)] + [(None, "x", "b"), (3, "same", "hot"), (3, "same", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rank": F.lit(1), "shard": F.lit(1), "size": F.lit("y")})
    got = sharding.stratified_shards(df, shards).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source in {r[2] for r in rows}:
        per = Counter(r.shard for r in got if r.stratum == source)
        assert max(per.values()) - min(per.get(s, 0) for s in sizes) <= 2
    plain = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert plain == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    place = lambda out: sorted((r.shard, r.slot, r.doc_id or -1) for r in out)
    assert place(got) == place(sharding.stratified_shards(df.repartition(5), shards).collect())
    assert sharding.stratified_shards(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50256) | st.just(0), max_size=400), st.sampled_from([1, 3, 64, 1024]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v, block)
    assert np.array_equal(simple8b.decode(words, offsets, len(v), block), v)
    if len(v):
        i = len(offsets) - 2
        n = len(v) - i * block
        alone = simple8b.decode(words[offsets[i] :], np.array([0, offsets[i + 1] - offsets[i]]), n, block)
        assert np.array_equal(alone, v[i * block :])


def awkward(n=400, seed=2):
    rng = random.Random(seed)
    bits = [*"aB1'sre vltmd   \n\t.,!_-é ²ß　中😀\x1cи", "'s", "'re", "'ll", "<|endoftext|>", "<s>", "  ", "the ", "▁"[:0], "ing "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", None, " ", "'s", "x" * 3000, "   lead"]


def library():
    """The tokenizers library as anybody loads it."""
    return Tokenizer.from_file(vocabulary_path())


def test_encoder_gives_the_librarys_ids():
    made, plain = encoder(vocabulary_path()), library()
    texts = [*awkward(), "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|", "<|end", "oftext|>"]
    assert plain.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    for _ in range(2):  # again, from the cache
        ids, counts = made.encode(Texts(pa.array(texts)))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tf, "PART_BYTES", 2000)
    monkeypatch.setattr(tf, "CHUNK_BYTES", 500)
    texts = awkward(150)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, "null key"), (5, "b"), (5, "a")]
    df = spark.createDataFrame(rows, DOC).withColumns({"key": F.lit(1), "words": F.lit(2)})
    got = tf.read_token_files(spark, tf.write_token_files(df)).orderBy("start").collect()
    made = library()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at = 0
    for g, (k, t) in zip(got, want, strict=True):
        ids = np.array([*made.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32, bytes(g.ids)) == (k, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += g.n_tokens
    assert tf.read_token_files(spark, tf.write_token_files(df.where("false"))).count() == 0


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(tc, "SPAN", 8)
    texts = awkward(200)
    histogram = tc.length_histogram(spark.createDataFrame(list(enumerate(texts)), DOC))
    made = library()
    lengths = np.array([len(made.encode(t or "", add_special_tokens=False).ids) for t in texts])
    for r in tc.with_suffix_sums(histogram).collect():
        n = r.n_tokens
        assert (r.docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens, r.total_tokens) == ((lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum(), np.minimum(lengths, n).sum(), lengths.sum())
        assert abs(r.share_within - (lengths <= n).mean()) < 1e-12
    assert {r.context_limit: (r.truncated_tokens, r.docs_cut) for r in tc.truncated_totals(histogram, [0, 5, 10**6]).collect()} == {x: (np.minimum(lengths, x).sum(), (lengths > x).sum()) for x in (0, 5, 10**6)}
    assert tc.quantiles(histogram, [0.5]).first().n_tokens == np.sort(lengths)[-(-len(lengths) // 2) - 1]
    assert tc.with_suffix_sums(tc.length_histogram(spark.createDataFrame([], DOC))).count() == 0


def test_sentencepiece_gives_the_librarys_ids_and_texts():
    import sentencepiece

    path = vocabulary_path(sp.MODEL)
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sp.piece_model(path)
    assert sp.merges(path)
    texts = awkward(800, 4)
    ids, counts = model.encode(Texts(pa.array(texts)))
    want = [library.encode(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert model.decode(ids, counts) == [t or "" for t in texts]


def test_viterbi_takes_the_greatest_sum_of_scores():
    """A unigram model: pieces with scores of their own, against all segmentations."""
    names = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "bb"]
    scores = {i: s for i, s in enumerate([0, -2.0, -3.0, -3.5, -4.0, -3.2, -4.5, -9.0, -8.0]) if i}
    model = sp.PieceModel.__new__(sp.PieceModel)
    model._tables(names, scores, {}, 0, False)
    sp.WordCache.__init__(model)
    table = {names[i]: (s, i) for i, s in scores.items()}

    def best(word):
        if not word:
            return 0.0, []
        found = [(best(word[: len(word) - k]), k) for k in range(1, min(3, len(word)) + 1) if word[len(word) - k :] in table]
        options = [(p[0] + table[word[len(word) - k :]][0], -k, [*p[1], table[word[len(word) - k :]][1]]) for p, k in found]
        return max(options, key=lambda o: (o[0], o[1]))[::2]

    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    ids, counts = model.encode(Texts(pa.array(texts)))
    at = 0
    for t, n in zip(texts, counts):
        got = ids[at : at + n].tolist()
        word = "▁" + t.replace(" ", "▁")
        assert abs(sum(scores[i] for i in got) - best(word)[0]) < 1e-9
        at += n


def test_sentencepiece_queries(spark):
    texts = awkward(60)
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumns({"ids": F.lit(1), "n_pieces": F.lit(2)})
    rows = sp.round_trips(df).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in sp.decoded(sp.encoded(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert sp.encoded(df.where("false")).count() == 0


def toxic_corpus(n=700, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice("the of and to walk talk green house river".split()) + rng.choice(["", "", "s", "ed"]) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["grumpf", "Gr0mpf", "zorgling", "zorgtum", "zorgheit", "zorgbar"]).replace("Gr0mpf", "grümpf"[:0] + "gruMpf")
        rows.append((i, " ".join(w)))
        labels.append((i, int(rng.random() < 0.8), int(bad)))
    return rows, labels


def test_folding():
    assert tx.fold("ІDІОТ!!") == " idiot " and tx.fold("l0s3r, $cum") == " loser scum " and tx.fold("ｂad 123") == " bad 123 " and tx.fold("") == "  "
    assert tx.fold("n00b a55hole hell0 hell0! 2024 1,000") == " noob asshole hello hello 2024 1 000 " and tx.fold("fun! $5 wow!!") == " fun 5 wow "


def naive_evidence(folded, lexicon):
    """Every place of every term and exception, by plain search."""
    best = {}
    covered = set()
    for phrase in lexicon.exceptions:
        at = folded.find(phrase)
        while at >= 0:
            covered |= set(range(at, at + len(phrase) - 1))
            at = folded.find(phrase, at + 1)
    for term, weight in lexicon.weights.items():
        at = folded.find(term)
        while at >= 0:
            if at not in covered:
                best[at] = max(best.get(at, 0.0), weight)
            at = folded.find(term, at + 1)
    return sum(best.values()), len(best), len(folded.split())


def test_automaton_finds_what_plain_search_finds():
    rng = random.Random(4)
    lexicon = tx.Lexicon({" ab ": 1.0, " a": 0.5, " abc ": 2.0, " c c ": 3.0, " b": 0.25}, (" ab c ", " c ab ", " a b a ", " b b "))
    made = lexicon.automaton()
    for _ in range(400):
        folded = tx.fold(" ".join(rng.choice(["a", "b", "c", "ab", "abc", "x"]) for _ in range(rng.randrange(14))))
        got, want = tx.evidence(folded, made), naive_evidence(folded, lexicon)
        assert abs(got[0] - want[0]) < 1e-9 and got[1:] == want[1:], folded


def test_exceptions_cancel_terms():
    lexicon = tx.Lexicon({" trash ": 2.0, " zorg": 3.0}, (" trash can ",))
    made = lexicon.automaton()
    assert tx.evidence(tx.fold("the trash can"), made)[0] == 0 and tx.evidence(tx.fold("trash! zorgbar"), made)[:2] == (5.0, 2)
    assert tx.evidence(tx.fold("nothing"), tx.Lexicon().automaton()) == (0.0, 0, 1)


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "grumpf")], DOC).withColumn("score", F.lit("x"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    lexicon = tx.learn(docs, marks)
    assert " grumpf " in lexicon.weights and any(t.startswith(" zorg") and not t.endswith(" ") for t in lexicon.weights)
    got = {r.doc_id: r for r in tx.scored(docs, lexicon).collect()}
    aside = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in aside) and sum(got[i].predicted == t for i, t in aside) / len(aside) > 0.97
    assert got[9000].score == got[9001].score < 0.5 and got[None].predicted == 1
    assert tx.harmless(docs, lexicon).columns == docs.columns
    none = tx.learn(docs, marks.where("false"))
    assert {r.score < 1e-9 for r in tx.scored(docs, none).collect()} == {True}


def test_quality_classifier(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice("the of and to walk talk green house river".split()) for _ in range(rng.randrange(5, 60))]
        junk = rng.random() < 0.3
        rows.append((i, " ".join(x + "***" if junk else x for x in w)))
        labels.append((i, int(not junk), 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "the of")], DOC).withColumn("score", F.lit("x"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qc.quality_scores(docs, marks).collect()}
    aside = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == q for i, q in aside) / len(aside) > 0.97
    assert len(got) == 503 and got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in qc.quality_scores(docs.repartition(7), marks).collect()}
    assert all(abs(again[k] - r.score) < 1e-6 for k, r in got.items())
    assert {r.score for r in qc.quality_scores(docs, marks.where("false")).collect()} == {0.5}
    assert qc.quality_scores(docs.where("false"), marks).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12000, 2 * qc.DIM + 1)).astype(np.float32)
    y = (rng.random(12000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = qc.train(x[:8000], y[:8000])
    x, y = x[8000:], y[8000:]
    p = net.probabilities(x)
    net.temperature = 1.0
    loss = lambda p: -np.log(np.where(y > 0, p, 1 - p)).mean()
    assert loss(p) < loss(net.probabilities(x))
    for low in np.arange(0, 1, 0.25):
        some = (p >= low) & (p < low + 0.25)
        assert some.sum() < 50 or abs(p[some].mean() - y[some].mean()) < 0.12
