"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones,
digits and signs that stand for letters in a word (a run of them with a letter on either
side; signs at a word's end are punctuation) to those letters, and all else that is no
letter or digit to single spaces. Lexicon terms are whole words or word
beginnings with weights; exception phrases cancel the terms inside them. A document's
evidence is the weighted count of its terms, and that count per words; a two-feature
logistic curve turns both into a probability.

The lexicon, its weights, the exceptions and the curve are learned from a bounded,
documented sample of labelled rows outside the held-out fold: all whole words, and word
beginnings, whose share of toxic documents is beyond chance for so many candidates.
Beginnings are looked for among those of 3 to 10 characters, and taken as long as all
their words agree. The sample is written once, and bounds all that is learned from it.

Defined results: null and empty texts have no terms and get the curve's value at zero;
texts of any length are matched whole; repeated rows get equal scores; without labels of
both kinds the lexicon is empty and every score is the share of toxic labels (0 with
none); null labels and null keys in the labels are left out, and of several labels of a
key the mean counts; documents with a null key are scored. Only the key and the text are
read, so further columns can have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ALNUM, Texts, drop, fields, gram_hashes, slices, stored

#: Labelled rows that the lexicon is learned from, at most, of either label.
SAMPLE = {1: 4000, 0: 8000}
#: Word beginnings have so many characters.
BEGINNING = (3, 10)

#: Letters of other scripts, and the Latin letters they look like.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝӏкмтвнαεορτυχικνıɡ", "aeopcyxijsdhqwlkmtbhaeoptuxiknig"))
#: Digits and signs, and the letters they stand for.
SUBSTITUTES = dict(zip("01345789@$!", "oieastbgasi"))

_TABLE = str.maketrans(LOOKALIKES | {chr(0xFF21 + i): chr(0x61 + i) for i in range(26)} | {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)} | {c: "" for c in "­​‌‍⁠﻿"})
_LETTERS = str.maketrans(SUBSTITUTES)
_STANDS = re.compile(r"[01345789@$!]+")
_GAPS = re.compile(r"[\W_]+")


def _stand(found: re.Match) -> str:
    run, text, a, b = found[0], found.string, found.start(), found.end()
    if b < len(text) and text[b].isalpha():
        return run.translate(_LETTERS)
    if a and text[a - 1].isalpha():
        size = len(run.rstrip("@$!"))
        return run[:size].translate(_LETTERS) + run[size:]
    return run


def fold(text: str) -> str:
    """The folded text, with a space before and after."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    text = _STANDS.sub(_stand, text)
    return f" {_GAPS.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Terms with weights (' word ' or ' beginning'), exception phrases (' a b '), and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, 0.0, True))
        for term, weight in self.weights.items():
            if term not in found:
                found.add_word(term, (term, weight, False))
        if not len(found):
            return None
        found.make_automaton()
        return found


def evidence(folded: str, automaton: ahocorasick.Automaton | None) -> tuple[float, int, int]:
    """Sum of weights (the best term of each place), number of places with a term, words."""
    words = folded.count(" ") - 1 if len(folded) > 2 else 0
    if automaton is None:
        return 0.0, 0, words
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (term, weight, is_exception) in automaton.iter(folded):
        start = end - len(term) + 1
        if is_exception:
            excused.append((start, end))
        else:
            best[start] = max(best.get(start, 0.0), weight)
    if excused and best:
        # phrases that overlap are one stretch; a term is cancelled if it starts in a stretch, before its last space
        stretches: list[tuple[int, int]] = []
        for a, b in sorted(excused):
            if stretches and a < stretches[-1][1]:
                stretches[-1] = (stretches[-1][0], max(b, stretches[-1][1]))
            else:
                stretches.append((a, b))
        at = 0
        for start in sorted(best):
            while at < len(stretches) and stretches[at][1] <= start:
                at += 1
            if at < len(stretches) and stretches[at][0] <= start:
                del best[start]
    return sum(best.values()), len(best), words


def features(total: float | np.ndarray, words: int | np.ndarray) -> tuple:
    return np.log1p(total), np.log1p(1000.0 * total / (np.asarray(words) + 20.0))


def probability(curve: Sequence[float], total: float, words: int) -> float:
    a, b = features(total, words)
    return float(1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, curve[0] + curve[1] * a + curve[2] * b)))))


def held_out(key: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, bounds: dict[int, int]) -> tuple[DataFrame, str]:
    """(text, y) of a bounded sample outside the held-out fold, by a hash of the key; and where it is stored."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_tl_key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    marks = marks.where(~held_out(F.col("_tl_key"))).withColumn("_tl_place", F.pmod(F.xxhash64("_tl_key", F.lit(3)), F.lit(1 << 30)))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    chosen = F.lit(False)
    for y, most in bounds.items():
        limit = int((1 << 30) * min(1.0, 0.97 * most / max(1, counts.get(y, 0)))) if counts.get(y, 0) > most else 1 << 30
        chosen = chosen | ((F.col("y") == y) & (F.col("_tl_place") < limit))
    # the sample's keys are bounded, so they can go to every task
    rows = docs.select(F.col(key).alias("_tl_key"), F.col(text).alias("text")).join(F.broadcast(marks.where(chosen).select("_tl_key", "y")), "_tl_key")
    # copies and most near copies share the smallest shingle; one of them is evidence enough
    found, path = stored(rows.mapInArrow(_sketch, T.StructType([*rows.schema.fields, *fields(_tl_sketch="long")])), "labelled")
    first = found.groupBy("_tl_sketch", "y").agg(F.min("_tl_key").alias("_tl_key"))
    sample, sample_path = stored(found.join(F.broadcast(first), ["_tl_key", "y", "_tl_sketch"], "left_semi").select("text", "y"), "labelled")
    drop(docs.sparkSession, path)
    return sample, sample_path


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of the document's five-word runs, or a hash of its words if it has fewer."""
    for batch in (b for whole in batches for b in slices(whole, "text")):
        words = Texts(batch.column("text")).words(ALNUM, fold=True)
        grams, inside = words.grams(5)
        low = np.full(batch.num_rows, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, words.owner()[: len(grams)][inside], grams[inside])
        short = np.flatnonzero(np.diff(words.doc) < 5)
        for i in short:
            low[i] = gram_hashes(words.hashes[words.doc[i] : words.doc[i + 1]], max(1, words.doc[i + 1] - words.doc[i])).sum(dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.view(np.int64))], [*batch.schema.names, "_tl_sketch"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per word and word beginning; a beginning also with one word that has it."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in (b for whole in batches for b in slices(whole, "text")):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            counts[y].update(set(fold(text or "").split()))
    yield pa.RecordBatch.from_pydict({"word": pa.array([w for y in (0, 1) for w in counts[y]], pa.string()), "y": pa.array([y for y in (0, 1) for _ in counts[y]], pa.int32()), "n": pa.array([n for y in (0, 1) for n in counts[y].values()], pa.int64())})


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: dict[int, int] | None = None) -> Lexicon:
    """The lexicon of a bounded sample of labelled documents."""
    rows, path = labelled_sample(docs, labels, label, key, text, sample or SAMPLE)
    found = _learn(rows)
    drop(docs.sparkSession, path)
    return found


def _learn(rows: DataFrame) -> Lexicon:
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    base = (math.log(share / (1 - share)) if 0 < share < 1 else (50.0 if share else -50.0), 0.0, 0.0)
    if not n1 or not n0:
        return Lexicon(curve=base)
    words = rows.select("text", "y").mapInArrow(_count_terms, T.StructType(fields(word="string", y="int", n="long")))
    by_word = words.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("d1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("d0"))
    low, high = BEGINNING
    size = F.explode(F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high))))
    starts = by_word.where(F.length("word") >= low).select("word", "d1", "d0", size.alias("k")).groupBy(F.expr("left(word, k)").alias("term")).agg(
        F.sum("d1").alias("d1"), F.sum("d0").alias("d0"), F.count(F.lit(1)).alias("kinds"), F.sum((F.col("d1") > 0).cast("int")).alias("kinds1"), F.max(F.when(F.col("d1") > 0, F.col("word"))).alias("top"), F.min(F.when(F.col("d1") > 0, F.col("word"))).alias("bottom")
    )
    candidates = by_word.count()
    # terms seen d1 times in toxic documents by chance: share ** d1 of the candidates
    enough = max(2, math.ceil((math.log(max(candidates, 2)) + 2) / -math.log(share)))
    toxic = F.col("d1") * (n0 + 1) >= 20 * (F.col("d0") + 0.5) * (n1 + 1)
    whole = by_word.where((F.col("d1") >= enough) & toxic).select("word", "d1", "d0").collect()
    begun = starts.where((F.col("d1") >= enough) & (F.col("kinds1") >= 3) & (F.col("d0") == 0)).collect()
    weight = lambda d1, d0: math.log((d1 + 0.5) / (n1 + 1)) - math.log((d0 + 0.5) / (n0 + 1))
    weights = {f" {r.word} ": weight(r.d1, r.d0) for r in sorted(whole, key=lambda r: r.word)}
    taken: list[str] = []
    for r in sorted(begun, key=lambda r: (len(r.term), r.term)):
        if any(r.term.startswith(t) for t in taken):
            continue
        taken.append(r.term)
        # as long as all its words have it in common: no wider than what was seen
        common = next((i for i, (a, b) in enumerate(zip(r.top, r.bottom)) if a != b), min(len(r.top), len(r.bottom)))
        weights[f" {r.bottom[:max(common, len(r.term))]}"] = weight(r.d1, r.d0)
    plain = Lexicon(weights, (), base)
    exceptions = _exceptions(rows, plain, enough)
    found = Lexicon(weights, exceptions, base)
    found.curve = _curve(_evidence_of(rows, found), base)
    return found


def _neighbours(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        counts: Counter = Counter()
        for batch in (b for whole in batches for b in slices(whole, "text")):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                folded = fold(text or "")
                seen = set()
                for end, (term, _, _) in automaton.iter(folded) if automaton else ():
                    start = end - len(term) + 1
                    stop = folded.index(" ", start + 1)
                    before = folded.rfind(" ", 0, start)
                    after = folded.find(" ", stop + 1)
                    seen |= {folded[before : stop + 1]} if before >= 0 else set()
                    seen |= {folded[start : after + 1]} if after >= 0 else set()
                counts.update((phrase, y) for phrase in seen)
        yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in counts], pa.string()), "y": pa.array([y for _, y in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _exceptions(rows: DataFrame, lexicon: Lexicon, enough: int) -> tuple[str, ...]:
    """Phrases of a term and a neighbour that occur in harmless documents nearly always."""
    found = rows.select("text", "y").mapInArrow(_neighbours(lexicon), T.StructType(fields(phrase="string", y="int", n="long")))
    d1, d0 = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    kept = found.groupBy("phrase").agg(d1.alias("d1"), d0.alias("d0")).where((F.col("d0") >= enough) & (20 * F.col("d1") <= F.col("d0")))
    return tuple(r.phrase for r in kept.orderBy("phrase").collect())


def _evidence_of(rows: DataFrame, lexicon: Lexicon) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in (b for whole in batches for b in slices(whole, "text")):
            got = [evidence(fold(t or ""), automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"total": pa.array([g[0] for g in got], pa.float64()), "words": pa.array([g[2] for g in got], pa.int64()), "y": batch.column("y")})

    # the sample is bounded, so its evidence is too
    return sorted(tuple(r) for r in rows.select("text", "y").mapInArrow(run, T.StructType(fields(total="double", words="long", y="int"))).collect())


def _curve(rows: list, base: tuple[float, float, float], steps: int = 60) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    total, words, y = (np.array(x, float) for x in zip(*rows))
    x = np.column_stack([np.ones(len(y)), *features(total, words)])
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    beta = np.array([base[0], 0.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    return tuple(float(b) for b in beta)


def _score(lexicon: Lexicon, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in (b for whole in batches for b in slices(whole, text)):
            got = [evidence(fold(t or ""), automaton) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            scores = pa.array([probability(lexicon.curve, g[0], g[2]) for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), scores, pa.array([g[1] for g in got], pa.int32())], [*keep, "_tl_score", "_tl_terms"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: key, held_out, score, predicted, n_terms."""
    out = T.StructType([docs.schema[key], *fields(_tl_score="double", _tl_terms="int")])
    found = docs.select(key, text).mapInArrow(_score(lexicon, text, [key]), out)
    return found.select(key, held_out(F.col(key)).alias("held_out"), F.col("_tl_score").alias("score"), (F.col("_tl_score") >= threshold).cast("int").alias("predicted"), F.col("_tl_terms").alias("n_terms"))


def harmless(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    out = T.StructType([*docs.schema.fields, *fields(_tl_score="double", _tl_terms="int")])
    return docs.mapInArrow(_score(lexicon, text, docs.columns), out).where(F.col("_tl_score") < threshold).select(*docs.columns)
