from __future__ import annotations

import hashlib
import re
import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tenderlake.functions import text as tx
from tenderlake.functions.fuzzy import partial_alignment, ratio, token_set_ratio
from tenderlake.functions.language import actor, binding_keyword, sentences

AWKWARD = ["", "plain text", "  a\t b\n", "co-\noperate", "so­\n  ft", "ﬁne ２ Å", "a b　c", "x\x1cy", "Ünïcode ß", "tab\r\nline\x0bv\x0cf", "é-\né", "a\n", "\n", "a\n\n"]


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", column.alias("out"))
    return [r.out for r in rows.orderBy("i").collect()]


def folded(t):
    t = unicodedata.normalize("NFKC", t)
    return re.sub(r"\s+", " ", re.sub(r"(\w)[-\xad]\s*\n\s*(\w)", r"\1\2", t)).strip()


def test_normalize_matches_python_and_is_idempotent(spark):
    got = one(spark, AWKWARD, tx.normalize(F.col("v")))
    assert got == [folded(t) for t in AWKWARD]
    assert one(spark, got, tx.normalize(F.col("v"))) == got


def test_nulls_stay_null(spark):
    assert one(spark, [None], tx.normalize(F.col("v"))) == [None]


def test_lines_are_those_of_splitlines(spark):
    assert one(spark, AWKWARD, tx.lines(F.col("v"))) == [t.splitlines() for t in AWKWARD]


def test_ids(spark):
    digest = hashlib.sha256(b"file|a b|2|1").hexdigest()[:10]
    assert one(spark, ["a\n b"], tx.requirement_id(F.lit("file"), F.col("v"), F.lit(2), F.lit(1))) == [f"REQ-{digest}"]
    assert one(spark, ["a  b"], tx.chunk_key(F.col("v"))) == ["CHK-" + hashlib.sha256(b"a b").hexdigest()[:12]]
    assert one(spark, ["My File (v2)!"], tx.file_stem_id(F.col("v"))) == ["my-file-v2"]
    assert one(spark, ["x" * 130], tx.truncate(F.col("v")))[0].endswith("…")
    assert tx.sanitize("a\ud800b") == "a���b" or "\ud800" not in tx.sanitize("a\ud800b")


def test_header_keys_ignore_digits(spark):
    assert len(set(one(spark, ["Page 3 of  9", "page 11 of 9"], tx.header_key(F.col("v"))))) == 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_is_the_indel_ratio(a, b):
    want = 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
    assert abs(ratio(a, b) - want) < 1e-9


def test_token_set_ratio():
    assert token_set_ratio("a b c", "c b a") == 100.0
    assert token_set_ratio("a b", "a b c d") == 100.0
    assert token_set_ratio("", "a") == 0.0
    assert 0 < token_set_ratio("submit the plan", "evaluate the plan") < 100


def test_partial_alignment_finds_the_window():
    score, start, end = partial_alignment("phase-in plan", "the phase in plan shall")
    assert score > 90 and "phase in plan" in "the phase in plan shall"[start:end]
    assert partial_alignment("abc", "xxabcxx") == (100.0, 2, 5)
    assert partial_alignment("zzzz", "abc", 50.0) is None


def test_sentences_and_guards(spark):
    texts = ["One. Two? Three! tail", "See No. 5 of it. Next.", "It costs 3.5. More follows. End", "U.S. law applies. Yes.", "", "no end"]
    assert one(spark, texts, sentences(F.col("v"))) == [
        ["One.", "Two?", "Three!", "tail"],
        ["See No. 5 of it.", "Next."],
        ["It costs 3.5. More follows.", "End"],
        ["U.S. law applies.", "Yes."],
        [],
        ["no end"],
    ]


def test_keywords_by_strength(spark):
    texts = ["You should and must go", "It shall not; it must", "marshall", "They ARE required to", None]
    assert one(spark, texts, binding_keyword(F.col("v"))) == ["must", "shall not", None, "are required to", None]


def test_actor(spark):
    texts = ["The offeror shall submit", "The Government will evaluate the offeror's plan", "Submit the form", "please submit", "award will be made"]
    assert one(spark, texts, actor(F.col("v"))) == ["offeror", "government", "offeror", "other", "government"]


def test_partial_alignment_is_the_best_window():
    """Against every window, scored one by one."""
    import random

    from tenderlake.functions.fuzzy import partial_alignment, ratio

    rng = random.Random(5)
    for _ in range(400):
        a, b = "".join(rng.choice("abc d") for _ in range(rng.randint(1, 8))), "".join(rng.choice("abc dz") for _ in range(rng.randint(8, 30)))
        windows = [(ratio(a, b[max(0, i) : min(len(b), i + len(a))]), max(0, i), min(len(b), i + len(a))) for i in range(1 - len(a), len(b))]
        best = max(w[0] for w in windows)
        for floor in (0.0, 60.0, 92.0):
            got = partial_alignment(a, b, floor)
            assert (got is None) == (best < floor) and (got is None or abs(got[0] - best) < 1e-9 and abs(ratio(a, b[got[1] : got[2]]) - best) < 1e-9)
