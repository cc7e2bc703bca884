from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import amendments, chunks, columns, crossmap, extraction, factors, grounding, outline, scoring, sweep
from tenderlake.plans.package import parse_package, run_analysis, run_extraction
from tenderlake.sources import discover, documents, records

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, table=None):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def fake_pdf(data: bytes) -> list[dict]:
    """Pages of a text file, parted by form feeds."""
    if data.startswith(b"broken"):
        raise ValueError("not a PDF")
    return [{"page_number": i, "text": t, "char_count": len(t), "metrics": {"has_images": 0.0}} for i, t in enumerate(data.decode().split("\f"), 1)]


FILL = "Plain words that make this page long enough to be read as one with text on it. "
L = f"SECTION L - INSTRUCTIONS\nL.1 Volumes\nThe offeror shall submit a phase-in plan.\n{FILL}"
M = f"SECTION M - EVALUATION\n(1) Factor 2, Transition\nFactor 2 - Transition\nThe Government will evaluate the phase-in plan.\n{FILL}"
C = f"SECTION C - WORK\nThe contractor shall clean the site. Staff must be trained.\n{FILL}"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("package")
    (top / "sub").mkdir()
    (top / "base file.pdf").write_bytes("\f".join([f"SOLICITATION, OFFER AND AWARD\n{FILL}{FILL}", C, L, M]).encode())
    (top / "broken.pdf").write_bytes(b"broken")
    (top / "old.doc").write_bytes(b"x")
    (top / "noext").write_bytes(b"")
    (top / "sub" / "note.docx").write_bytes(docx(["SECTION H - SPECIAL", "H.1 Insurance", "Section L.1 is hereby changed to read anew."], [["a", "b"]]))
    return str(top)


def test_discovery(spark, folder):
    rows = {r.filename: r for r in discover.discover(spark, folder).collect()}
    assert list(rows) == sorted(rows)
    assert rows["base file.pdf"].kind == "pdf" and rows["base file.pdf"].file_id.endswith("-base-file") and len(rows["base file.pdf"].sha256) == 64
    assert rows["old.doc"].error.startswith(".doc legacy") and rows["noext"].error == "unsupported file type: (no extension)"
    assert rows["sub/note.docx"].kind == "docx"
    tiny = {r.filename: r for r in discover.discover(spark, folder, most_bytes=3).collect()}
    assert tiny["base file.pdf"].file_id == "000000000000-base-file" and "exceeds cap" in tiny["base file.pdf"].error and tiny["base file.pdf"].file_type == "pdf"


def test_discovery_of_odd_files(spark, tmp_path):
    (tmp_path / "pack").mkdir()
    for name in ("_hidden.pdf", ".dot.docx", "a b%20c.PDF", "x.tar.gz"):
        (tmp_path / "pack" / name).write_bytes(name.encode())
    (tmp_path / "out.pdf").write_bytes(b"secret")
    (tmp_path / "pack" / "link.pdf").symlink_to(tmp_path / "out.pdf")
    rows = {r.filename: r for r in discover.discover(spark, str(tmp_path / "pack")).collect()}
    assert set(rows) == {"_hidden.pdf", ".dot.docx", "a b%20c.PDF", "x.tar.gz", "link.pdf"}
    assert rows["_hidden.pdf"].kind == "pdf" and rows["a b%20c.PDF"].kind == "pdf" and rows[".dot.docx"].kind == "docx"
    assert rows["link.pdf"].error.startswith("outside package directory") and rows["link.pdf"].sha256 == "" and rows["x.tar.gz"].error == "unsupported file type: .gz"
    parsed = documents.parsed_files(discover.discover(spark, str(tmp_path / "pack")), "pdf", fake_pdf)
    assert {r.parse_status for r in parsed.collect()} == {"ok"} and parsed.count() == 2


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"x")
    listed = discover.listing(spark, str(tmp_path))
    (tmp_path / "b.pdf").unlink()
    rows = {r.filename: r for r in discover.identified(discover.with_hashes(spark, listed)).collect()}
    assert rows["a.pdf"].kind == "pdf" and rows["b.pdf"].kind == "rejected" and rows["b.pdf"].file_id == "000000000000-b"
    assert rows["b.pdf"].error.startswith("unreadable file: ") and rows["b.pdf"].file_type == "other"


def test_columns_and_layout_of_pdfs(spark, tmp_path):
    """A parser that gives words' places: column pages are read by rows, and page one's layout text shows its form."""

    def parser(data: bytes) -> list[dict]:
        words = [{"text": "Item", "x0": 66.0, "top": 10.0}]
        for i in range(8):
            words += [{"text": f"{i}.", "x0": 66.0, "top": 100.0 + 12 * i}, {"text": f"body {i} (cid:3)", "x0": 210.0, "top": 100.0 + 12 * i}]
        words += [{"text": "more", "x0": 210.0, "top": 200.0 + 12 * i} for i in range(4)]
        base = {"char_count": 400, "height": 700.0}
        return [
            base | {"page_number": 1, "text": FILL * 3, "metrics": documents.text_metrics("", False), "words": [], "layout_text": "SOLICITATION,  OFFER\nAND AWARD"},
            base | {"page_number": 2, "text": "spliced", "metrics": documents.text_metrics("spliced", True), "words": words, "layout_text": None},
        ]

    (tmp_path / "cols.pdf").write_bytes(b"x")
    package = parse_package(spark, str(tmp_path), pdf=parser)
    pages = {r.page_number: r for r in documents.page_rows(documents.parsed_files(discover.discover(spark, str(tmp_path)), "pdf", parser))[0].collect()}
    assert pages[1].text == FILL * 3 and pages[2].text.split("\n")[1] == "0. body 0 (cid:3)" and pages[2].metrics == {"cid_count": 8.0, "replacement_char_count": 0.0, "has_images": 1.0}
    assert package.files.first().form == "sf33" and package.files.first().form_source == "layout_text"


def test_docx(spark):
    blocks = documents.docx_blocks(docx(["one", "two"], [["a", "b"], ["c", "d"]]))
    assert [(b["ordinal"], b["kind"], b["text"]) for b in blocks] == [(0, "paragraph", "one"), (1, "paragraph", "two"), (2, "table", "")]
    assert blocks[2]["table"] == [["a", "b"], ["c", "d"]]
    with pytest.raises(Exception):
        documents.docx_blocks(b"nothing")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "0" * 1_000_000)
    assert "ratio exceeds" in documents.archive_error(bomb.getvalue())


def write_drafts(path, rows):
    path.write_text("\n".join(json.dumps({"chunk_key": k, "requirements": r}) for k, r in rows))
    return str(path)


def draft(text, parent=None, guess="other"):
    return {"verbatim_text": text, "atomic_obligation": text, "binding_keyword": "none", "type_guess": guess, "parent_index": parent}


def test_whole_run(spark, folder, tmp_path):
    package = parse_package(spark, folder, "demo", pdf=fake_pdf)
    status = {r.filename: (r.parse_status, r.doc_role) for r in package.files.collect()}
    assert status["base file.pdf"] == ("ok", "base_solicitation") and status["broken.pdf"][0] == "failed" and status["old.doc"][0] == "rejected"
    assert package.package.first().classification == "full_ucf"
    assert "full_ucf" in package.report() and package.metrics().first().files == 5
    rows = chunks.chunks(package.files, package.sections, package.pages, package.blocks)
    by_label = {r.section_label: r for r in rows.collect()}
    assert {"L", "L.1", "M", "C", "H"} <= set(by_label)
    shall = "The offeror shall submit a phase-in plan."
    drafts = write_drafts(
        tmp_path / "drafts.jsonl",
        [
            (by_label["L"].chunk_key, [draft(shall)]),
            (by_label["M"].chunk_key, [draft("The Government will evaluate the phase-in plan.")]),
            (by_label["C"].chunk_key, [draft("The contractor shall clean the site."), draft("clean the site.", 0), draft("Nothing like this is there at all, in any section")]),
            ("CHK-000000000000", [draft("unused")]),
        ],
    )
    found = run_extraction(package, records.load_drafts(spark, drafts))
    reqs = {r.verbatim_text: r for r in found.requirements.collect()}
    assert len(reqs) == 5
    lreq = reqs[shall]
    # L and L.1 are the same page and text: one requirement, under the deeper label
    assert lreq.section_label == "L.1" and lreq.req_type == "instruction" and lreq.page == 3 and lreq.binding_keyword == "shall" and lreq.verified
    assert reqs["clean the site."].parent_id == reqs["The contractor shall clean the site."].requirement_id
    assert not reqs["Nothing like this is there at all, in any section"].verified
    m = found.metrics().first()
    assert m.requirements == 5 and m.drafts_unused == 1 and m.chunks_total == rows.count()
    assert any("must be trained" in r.sentence for r in found.missed.collect())
    verdicts = tmp_path / "verdicts.jsonl"
    verdicts.write_text(json.dumps({"requirement_id": lreq.requirement_id, "verdict": "fully_compliant", "rationale": "yes", "confidence": "high", "profile_evidence": []}))
    done = run_analysis(package, found.requirements, records.load_verdicts(spark, str(verdicts)))
    matrix = {r.requirement_id: r for r in done.rows().collect()}
    assert len(matrix) == 5 and matrix[lreq.requirement_id].compliance == "Fully Compliant" and matrix[lreq.requirement_id].cross_map == "Mapped"
    assert sum(r.n for r in outline.outline_coverage(done.placements).collect()) == 5
    assert "Compliance:" in done.report() and "Requirements: 5" in found.report()


@pytest.mark.parametrize(
    "text, why",
    [("{bad", "2: not valid JSON"), ('{"requirements": []}', "2: missing 'chunk_key'"), ('{"chunk_key": "a", "requirements": []}', "2: duplicate chunk_key"), ('{"chunk_key": "b", "requirements": [{"verbatim_text": "x"}]}', "2: does not match")],
)
def test_records_are_strict(spark, tmp_path, text, why):
    path = tmp_path / "d.jsonl"
    path.write_text('{"chunk_key": "a", "requirements": []}\n' + text + "\n\n")
    with pytest.raises(records.BadRecords, match=why):
        records.load_drafts(spark, str(path))


def test_empty_recordings(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text("\n \n")
    with pytest.raises(records.BadRecords, match="empty recording"):
        records.load_drafts(spark, str(path))


def greedy(sizes, most):
    out, i, n = [], 0, len(sizes)
    while i < n:
        j, total = i, 0
        while j < n and (j == i or total + 1 + sizes[j] <= most):
            total += sizes[j] + (j > i)
            j += 1
        out.append((i, j - 1))
        if j >= n:
            break
        i = max(j - 1, i + 1)
    return out


def test_windows_are_the_greedy_ones(spark):
    import random

    rng = random.Random(2)
    cases = [[rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250]) for _ in range(rng.randint(0, 12))] for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, sizes array<int>")
    for r in df.select("i", chunks.windows(F.col("sizes"), 100).alias("w")).collect():
        assert [(w.first, w.last) for w in r.w] == greedy(cases[r.i], 100), cases[r.i]


def test_page_map_and_offsets(spark):
    df = spark.createDataFrame([([(4, "abc"), (5, ""), (6, "de")],)], "p array<struct<page_number:int,text:string>>").select(chunks.page_map(F.col("p")).alias("m"))
    assert [tuple(b) for b in df.first().m] == [(0, 3, 4), (4, 4, 5), (5, 7, 6)]
    got = [df.select(grounding.page_for_offset(F.col("m"), F.lit(o)).alias("x")).first().x for o in (0, 2, 3, 4, 5, 99, -1)]
    assert got == [4, 4, 4, 5, 6, 6, None]


def test_grounding(spark):
    rows = [("shall  submit", "they shall\nsubmit it"), ("shall sumbit the plan now", "they shall submit the plan now ok"), ("", "x"), ("y", ""), ("absent words", "other text"), (None, "x")]
    got = [(r.match, r.char_start, r.char_end) for r in grounding.ground(spark.createDataFrame(rows, "verbatim_text string, text string")).collect()]
    assert got[0] == ("exact", 5, 17) and got[1][0] == "fuzzy" and got[2:] == [("none", None, None)] * 4


def test_exact_matches_are_all_containments(spark):
    texts = ["the quick brown fox", "quick brown", "brownish fox", "", None, "a quick brown  x", "ick brown fo"]
    quotes = ["quick brown fox", "ick brown fo", "brown", "fox", "", None, "quick brown", "e quick brown f"]
    t = spark.createDataFrame(list(enumerate(texts)), "t int, folded string")
    q = spark.createDataFrame(list(enumerate(quotes)), "q int, quote string")
    got = {(r.q, r.t, r.char_start) for r in grounding.exact_matches(q, t).collect()}
    assert got == {(i, j, a.find(b)) for i, b in enumerate(quotes) if b for j, a in enumerate(texts) if a and b in a}


REQ = "requirement_id string, file_id string, page int, verbatim_text string, section_label string, doc_role string, binding_keyword string, atomic_obligation string, req_type string"


def reqs(spark, rows):
    base = {"file_id": "f", "page": 1, "verbatim_text": "x", "section_label": "L.1", "doc_role": "attachment", "binding_keyword": "none", "atomic_obligation": "", "req_type": "other"}
    names = [c.split()[0] for c in REQ.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], REQ)


def test_reconcile_is_by_page(spark):
    pages = spark.createDataFrame([("f", 1, "You shall go. They must stay."), ("g", 1, "You shall go now.")], "file_id string, page_number int, text string")
    hits = sweep.sweep_hits(pages)
    r = reqs(spark, [{"requirement_id": "a", "verbatim_text": "shall go"}, {"requirement_id": "b", "page": None, "verbatim_text": "must stay"}])
    updated, missed = sweep.reconcile(r, hits)
    assert {x.requirement_id: x.binding_keyword for x in updated.collect()} == {"a": "shall", "b": "none"}
    assert [x.sentence for x in missed.collect()] == ["They must stay."]
    assert len(sweep.reconcile(r, hits, match_file=True)[1].collect()) == 2
    assert [x.requirement_id for x in sweep.over_extractions(r, hits).collect()] == ["b"]


def test_amendments(spark):
    change = {"requirement_id": "z", "doc_role": "amendment", "verbatim_text": "Section L.4 is hereby revised; clause M is deleted", "section_label": "L.4"}
    rows = [change, {"requirement_id": "a", "section_label": "L.4.2"}, {"requirement_id": "b", "section_label": "L"}, {"requirement_id": "c", "section_label": "L.40"}, {"requirement_id": "d", "section_label": "m.1"}, {"requirement_id": "e", "section_label": None}]
    got = {r.requirement_id: (r.is_amendment_change, r.possibly_modified, r.affects) for r in amendments.flag_amendments(reqs(spark, rows)).collect()}
    assert got["z"] == (True, False, []) and all(got[k] == (False, True, ["z"]) for k in "abd") and got["c"][1] is False and got["e"][1] is False


def test_factors_as_of(spark):
    pages = spark.createDataFrame([("f", 1, f"intro\n(1) Factor 2, Title\nbody one\n{FILL}", "ok"), ("f", 3, "alpha\n (2)  Factor 3: More\nomega", "ok"), ("f", 4, "see Factor 9, inline", "ok")], "file_id string, page_number int, text string, quality string")
    anchors = factors.factor_anchors(pages)
    assert sorted((a.page, a.offset, a.factor) for a in anchors.collect()) == [(1, 5, "FACTOR-2"), (3, 5, "FACTOR-3")]
    rows = [("a", 1, "intro"), ("b", 1, "body one"), ("c", 2, "none"), ("d", 3, "alpha"), ("e", 3, "omega"), ("g", 3, "not there"), ("h", 4, "inline"), ("i", None, "x")]
    r = reqs(spark, [{"requirement_id": i, "page": p, "verbatim_text": t} for i, p, t in rows])
    got = {x.requirement_id: x.factor for x in factors.assign_factors(r, anchors, pages).collect()}
    assert got == {"b": "FACTOR-2", "c": "FACTOR-2", "d": "FACTOR-2", "e": "FACTOR-3", "h": "FACTOR-3"}
    cover = {x.factor: x.n for x in factors.factor_coverage(r, factors.assign_factors(r, anchors, pages)).collect()}
    assert cover == {"FACTOR-2": 3, "FACTOR-3": 2, "no factor": 3}


def test_cross_map(spark):
    rows = [
        {"requirement_id": "l1", "req_type": "instruction", "verbatim_text": "submit the phase-in plan"},
        {"requirement_id": "l2", "req_type": "instruction", "verbatim_text": "paint bridges yellow"},
        {"requirement_id": "m1", "req_type": "evaluation", "verbatim_text": "evaluate the phase-in plan"},
        {"requirement_id": "m2", "req_type": "evaluation", "verbatim_text": "zebra crossing"},
        {"requirement_id": "c1", "verbatim_text": "the phase-in plan"},
        {"requirement_id": "c2", "verbatim_text": "quixotic jumps"},
    ]
    df = reqs(spark, rows)
    got = {r.requirement_id: (r.gap_kind, r.counterpart_ids) for r in crossmap.cross_map(df).collect()}
    assert got == {"l1": ("mapped", ["m1"]), "l2": ("l_without_m", []), "m1": ("mapped", ["l1"]), "m2": ("evaluation_process", []), "c1": ("mapped", ["l1", "m1"]), "c2": ("sow_without_either", [])}
    under = spark.createDataFrame([("l1", "F1"), ("m1", "F2"), ("m2", "F1")], "requirement_id string, factor string")
    got = {r.requirement_id: r.gap_kind for r in crossmap.cross_map(df, under).collect()}
    assert got["l1"] == "l_without_m" and got["m2"] == "m_without_l"
    assert {r.gap_kind: r.n for r in crossmap.gap_summary(crossmap.cross_map(df)).collect()} == {"mapped": 3, "l_without_m": 1, "m_without_l": 0, "sow_without_either": 1, "evaluation_process": 1}


def test_scoring(spark):
    pred = spark.createDataFrame([(0, "f", 1, "submit the plan"), (1, "f", 1, "submit the plan"), (2, "f", 2, "paint"), (3, "f", None, "submit the plan"), (4, "g", 9, "x")], "pred_ord long, file_id string, page int, verbatim_text string")
    gold = spark.createDataFrame([(0, "f", 1, "submit the plan"), (1, "f", 2, "other words"), (2, "f", None, "submit the plan")], "gold_ord long, file_id string, page int, verbatim_text string")
    r = scoring.score(pred, gold).first()
    assert (r.matched, r.total_preds, r.total_golds, r.out_of_scope) == (1, 4, 3, 1) and r.precision == 0.25
    assert "1/3 golden matched" in scoring.score_line(r)
    assert scoring.score(pred, gold, scoped=False).first().recall == r.recall
    empty = scoring.score(pred.where("false"), gold.where("false")).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)
    ranges = spark.createDataFrame([("f", [1, 2, 3])], "file_id string, pages array<int>")
    assert scoring.score_exhaustive(pred, gold, ranges).first().scope_pages == 3
    assert scoring.score_exhaustive(pred, gold, ranges.where("false")).count() == 0
    assert [tuple(x) for x in scoring.unverified_pages(ranges, gold, pred).collect()] == [("f", 3)]


def test_promote(spark):
    pred = spark.createDataFrame([(0, "f", 1, "submit the plan", "shall"), (1, "f", 1, "new duty", "are required to"), (2, "f", None, "pageless", "must"), (3, "f", 7, "far", "must")], "pred_ord long, file_id string, page int, verbatim_text string, binding_keyword string").withColumns({"filename": F.lit("f.pdf"), "atomic_obligation": F.lit("")})
    gold = spark.createDataFrame([(0, "f", 1, "submit the plan")], "gold_ord long, file_id string, page int, verbatim_text string")
    good, bad = scoring.promote(pred, gold, "f", [1, 2], "L", "instruction", F.col("verbatim_text") != "pageless")
    assert [(r.verbatim_text, r.binding_keyword) for r in good.collect()] == [("new duty", "none")] and [r.verbatim_text for r in bad.collect()] == ["pageless"]


def test_columns(spark):
    lines = [("1", 66, 100 + 12 * i, f"body {i}") for i in range(8)]
    words = [("f", 1, "Item", 66.0, 10.0)] + [w for n, x, top, text in lines for w in [("f", 1, f"{n}.{top}", float(x), float(top)), ("f", 1, text, 210.0, float(top) + 0.1)]]
    words += [("f", 1, "more", 210.0, 200.0 + 12 * i) for i in range(4)]
    df = spark.createDataFrame(words, "file_id string, page_number int, text string, x0 double, top double")
    edges = columns.body_edges(df)
    assert edges.first().edge == 210.0
    heights = spark.createDataFrame([("f", 1, 700.0)], "file_id string, page_number int, height double")
    text = columns.columnar_text(df, edges, heights).first().text.split("\n")
    assert text[0] == "Item" and text[1].endswith("body 0") and text[-1].endswith("more more more more")


def test_no_columns_in_prose(spark):
    df = spark.createDataFrame([("f", 1, "w", 66.0 + (i % 3), 12.0 * i) for i in range(20)], "file_id string, page_number int, text string, x0 double, top double")
    assert columns.body_edges(df).count() == 0


def test_ids_order_and_occurrence(spark):
    rows = [(0, None), (1, 0), (2, 0), (3, 9), (4, 4), (5, -1)]
    df = spark.createDataFrame([("b", i, p, 6) for i, p in rows], "b string, draft_idx int, parent_index int, n_drafts int")
    got = {r.draft_idx: (r.root_idx, r.atomic_ord) for r in extraction.atomic_ordinals(extraction.root_index(df, ["b"]), ["b"]).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_bands_and_offsets_of_long_files(spark, monkeypatch):
    """In small blocks and stretches, against the array forms."""
    import random

    monkeypatch.setattr(chunks, "BLOCK_PAGES", 3)
    monkeypatch.setattr(grounding, "STRETCH", 16)
    rng = random.Random(7)
    rows = [(f, p, "x" * rng.choice([0, 1, 5, 40])) for f in "ab" for p in range(1, 30)]
    pages = spark.createDataFrame(rows, "file_id string, page_number int, text string")
    bands = chunks.page_bands(pages.withColumn("n_chars", F.length("text")))
    mapped = pages.groupBy("file_id").agg(chunks.page_map(F.array_sort(F.collect_list(F.struct("page_number", "text")))).alias("m"))
    want = sorted((r.file_id, b.page, b.char_start, b.char_end) for r in mapped.collect() for b in r.m)
    assert sorted((r.file_id, r.page, r.char_start, r.char_end) for r in bands.collect()) == want
    asked = spark.createDataFrame([(f, i) for f in "abc" for i in range(-2, 900, 7)], "file_id string, at long")
    plain = asked.join(mapped, "file_id", "left").select("file_id", "at", grounding.page_for_offset(F.col("m"), F.col("at")).alias("page"))
    assert sorted(map(tuple, grounding.pages_for_offsets(asked, bands).select("file_id", "at", "page").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_guarded_sentences(spark):
    from tenderlake.functions.language import sentences

    cases = {
        "See no. 5 of sec. L.2. It shall go. Stop": ["See no. 5 of sec. L.2. It shall go.", "Stop"],
        "e.g. i.e. etc. one. Two? no? Yes!": ["e.g. i.e. etc. one.", "Two?", "no? Yes!"],
        "Version 3.1. next. 3. end": ["Version 3.1. next.", "3.", "end"],
        "": [],
        "... ! a": ["...", "!", "a"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.s for r in df.select("t", sentences(F.col("t")).alias("s")).collect()} == cases
