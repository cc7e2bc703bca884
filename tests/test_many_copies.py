"""Operators on rows that share texts, labels and pages: the same results as pair by pair, without the pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tenderlake.functions.fuzzy import Aligner, partial_alignment, ratio
from tenderlake.functions.text import normalize
from tenderlake.operators import amendments, crossmap, factors, grounding, scoring, sweep


def _slow_alignment(query, text, floor):
    m, best = len(query), None
    for start in range(1 - m, len(text)):
        low, high = max(0, start), min(len(text), start + m)
        score = ratio(query, text[low:high])
        if score >= floor and (best is None or score > best[0]):
            best = (score, low, high)
    return best


def test_alignment_of_many_queries_equals_all_windows():
    """one aligner of a text serves all its queries."""
    draw = random.Random(3)
    words = "the offeror shall submit a plan on high item12 records at no cost".split()
    text = " ".join(draw.choice(words) for _ in range(60))
    aligner = Aligner(text)
    for _ in range(40):
        at = draw.randrange(len(text) - 90)
        query = text[at : at + draw.randint(5, 90)].replace(draw.choice(words), "on", 1)
        assert partial_alignment(query, text, 92.0, aligner) == _slow_alignment(query, text, 92.0), query


def test_first_places_equal_find():
    """quotes with cut words, of few words, repeated, at the ends, absent and empty."""
    draw = random.Random(4)
    text = " ".join(draw.choice(["a", "bb", "ab", "abc", "b"]) for _ in range(200))
    quotes = ["", "a", "zz", text, text + " a", "b a b zz"]
    for _ in range(300):
        at = draw.randrange(len(text) - 30)
        quotes.append(" ".join(text[at : at + draw.randint(1, 30)].split()) or "a")
    assert grounding.first_places(text, quotes)[1:] == [text.find(q) for q in quotes][1:]
    assert grounding.first_places(text, quotes)[0] == -1


def test_ground_on_equals_ground(spark):
    """a text is no longer copied to each of its quotes."""
    quotes = ["The offeror shall submit a plan.", "The offerer shall submit a plan.", "plan", "", None, "nowhere to be seen at all"]
    rows = spark.createDataFrame([(i, i % 3, q) for i, q in enumerate(quotes * 3)], "n int, p int, verbatim_text string")
    texts = spark.createDataFrame([(0, "Here. The offeror shall\nsubmit a plan. The offeror shall submit a plan."), (1, "")], "p int, text string")
    columns = ["n", "match", "char_start", "char_end", "score"]
    want = grounding.ground(rows.join(texts, "p", "left")).select(*columns).collect()
    assert sorted(grounding.ground_on(rows, texts, ["p"]).select(*columns).collect()) == sorted(want)


def test_factor_anchors_fold_each_part_once(spark):
    """offsets are those of the whole fold before each heading."""
    text = "a-\nb  x\n\n(1) Factor 1, One\nsome-\n(2) Factor 2, Two\n\n\n(3) Factor 3: x\nword-\nfactor\n (4) Factor 4 - y"
    pages = spark.createDataFrame([("f", 1, text, "ok"), ("f", 2, "(1) Factor 7, One", "ok")], "file_id string, page_number int, text string, quality string")
    found = {r.factor: r.offset for r in factors.factor_anchors(pages).collect()}
    starts = {n: text.index(f"({n})" if n < 4 else " (4)") for n in (1, 2, 3, 4)}
    want = spark.createDataFrame([(f"FACTOR-{n}", text[:at]) for n, at in starts.items()], "k string, t string").select("k", F.length(normalize(F.col("t"))).alias("n"))
    assert found == {r.k: r.n for r in want.collect()} | {"FACTOR-7": 0}


def test_changes_are_listed_once_per_label(spark):
    """a label's list serves all its rows; a change isn't in its own."""
    rows = [(f"R{i}", "amendment" if i < 3 else "attachment", f"Section {'L' if i else 'L.1.2'} is hereby changed to read anew.", s) for i, s in enumerate(["L.1", "L.1", "M", "L.1", "L.1.2.3", "M", "l", ""])]
    reqs = spark.createDataFrame(rows, "requirement_id string, doc_role string, verbatim_text string, section_label string")
    flagged = amendments.flag_amendments(reqs).withColumn("sha", F.sha2(F.array_join("affects", ","), 256)).collect()
    assert {r.requirement_id: r.affects for r in flagged} == {"R0": ["R1", "R2"], "R1": ["R0", "R2"], "R2": [], "R3": ["R0", "R1", "R2"], "R4": ["R0", "R1", "R2"], "R5": [], "R6": ["R0", "R1", "R2"], "R7": []}
    want = {(r.requirement_id, len(r.affects), r.affects[0], r.sha) for r in flagged if r.possibly_modified}
    assert {tuple(r) for r in amendments.affected(reqs).collect()} == want


def test_counted_cross_map_equals_listed(spark):
    """counterparts are counted without their list."""
    rows = [(f"R{i}", t, f"submit the plan for item {i % 3}", "") for i, t in enumerate(["instruction", "evaluation", "sow_pws"] * 4)]
    reqs = spark.createDataFrame(rows, "requirement_id string, req_type string, verbatim_text string, atomic_obligation string")
    under = spark.createDataFrame([(f"R{i}", f"F{i % 2}") for i in range(7)], "requirement_id string, factor string")
    listed = crossmap.cross_map(reqs, under).select("requirement_id", F.size("counterpart_ids").cast("long").alias("n"), "gap_kind", "rationale", "score").collect()
    assert sorted(crossmap.cross_map(reqs, under, listed=False).collect()) == sorted(listed)


def test_texts_that_hold_each_other_either_way(spark):
    """Pairs by text, also with cut words, one word, and sentences inside requirements."""
    quotes = ["offeror shall submit a pla", "shall", "must", "The offeror shall submit a plan now. It must be good.", "x must do y", "", "shall not"]
    sentences = ["The offeror shall submit a plan now.", "It must be good.", "It must be good.", "He x must do yz", "She shall not go"]
    reqs = spark.createDataFrame([(f"R{i}", "f", 1 + i // 7, q, "none") for i, q in enumerate(quotes * 2)], "requirement_id string, file_id string, page int, verbatim_text string, binding_keyword string")
    hits = spark.createDataFrame([(f, 1, i, s, f"k{i}") for f in ("f", "g") for i, s in enumerate(sentences)], "file_id string, page int, hit_idx int, sentence string, binding_keyword string")
    for match_file in (False, True):
        want = {(r.requirement_id, h.file_id, h.hit_idx) for r in reqs.collect() for h in hits.collect() if r.page == h.page and (not match_file or r.file_id == h.file_id) and r.verbatim_text and (r.verbatim_text in h.sentence or h.sentence in r.verbatim_text)}
        assert {(r.requirement_id, r.file_id, r.hit_idx) for r in sweep.covering(reqs, hits, match_file).collect()} == want
        updated, missed = sweep.reconcile(reqs, hits, match_file)
        first = {r: f"k{min((f, i) for q, f, i in want if q == r)[1]}" for r, _, _ in want}
        assert {r.requirement_id: r.binding_keyword for r in updated.collect()} == {r.requirement_id: first.get(r.requirement_id, "none") for r in reqs.collect()}
        assert {(r.file_id, r.hit_idx) for r in missed.collect()} == {(h.file_id, h.hit_idx) for h in hits.collect()} - {(f, i) for _, f, i in want}
        assert {r.requirement_id for r in sweep.over_extractions(reqs, hits, match_file).collect()} == {r.requirement_id for r in reqs.collect()} - {r for r, _, _ in want}


def test_greedy_matches_by_text_equal_those_by_row(spark):
    """Equal rows are matched from their lists, as if each pair had been made."""
    draw = random.Random(5)
    text = lambda: f"The offeror shall submit a plan for item{draw.randrange(6)}{draw.choice(['.', '!', ' x'])}"
    preds = spark.createDataFrame([(i, "f", i % 2, text()) for i in range(80)], "pred_ord long, file_id string, page int, verbatim_text string")
    golds = spark.createDataFrame([(i, "f", i % 2, text()) for i in range(50)], "gold_ord long, file_id string, page int, verbatim_text string")
    want = scoring.assign(scoring.match_pairs(preds, golds)).collect()
    assert sorted(scoring.matches(preds, golds).collect()) == sorted(want) and len(want) > 30


def test_sharp_s_stays_one_letter(spark):
    """as the SQL folds it."""
    from tenderlake.functions.text import header_key

    assert spark.createDataFrame([("Straße 12",)], "v string").select(header_key(F.col("v"))).first()[0] == "STRAẞE"


def test_long_archives_still_unpack_to_too_much(spark, tmp_path):
    """A long conversation's archive that should fail does so."""
    from tenderlake.plans import catalogue_package as cp

    rows = [(c, t, "user", " ".join(str((t * 7919 + i * 104729) % 1000003) for i in range(400))) for c in (5, 6) for t in range(150)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.file_id: r.parse_status for r in cp.q_docx_status(spark, str(tmp_path)).collect()}
    assert found == {"5": "failed", "6": "ok"}


def test_packages_without_lettered_sections_have_no_class_row(spark):
    """as the SQL, which knows packages by their lettered sections."""
    from tenderlake.plans import catalogue

    files = spark.createDataFrame([("P0", 0, "F0", "F0.pdf"), ("P1", 5, "F5", "F5.pdf")], "package_name string, file_ord int, file_id string, filename string")
    nodes = [("F0", 0, "L", "instructions", "heading"), ("F0", 1, "EVALUATION", "evaluation", "role_title"), ("F5", 0, "EVALUATION", "evaluation", "role_title")]
    tree = spark.createDataFrame([(*n, None, "pages", "x", 1, 2) for n in nodes], "file_id string, dfs_ord int, label string, role string, detection string, parent_id string, kind string, title string, unit_start int, unit_end int")
    assert [(r.package_name, r.evidence) for r in catalogue._classes(files, tree).collect()] == [("P0", ["Section L found at pages 1-2 of F0.pdf"])]
