from __future__ import annotations

from tenderlake.operators import classify, sections as s


def tree(spark, pages):
    return s.section_tree(spark.createDataFrame([("f", n, t) for n, t in pages], "file_id string, page_number int, text string"))


def candidates(spark, text):
    df = spark.createDataFrame([("f", 1, text)], "file_id string, page_number int, text string")
    return s.heading_candidates(s.pages_as_lines(df)).orderBy("line_index").collect()


def test_signals(spark):
    rows = candidates(spark, "Section L — Instructions\nPART IV: Stuff\nL.4.2 Volumes\nStatement of Work\nprose\n\nSECTION Z - none")
    assert [(r.signal, r.label, r.title) for r in rows] == [
        ("heading", "L", "INSTRUCTIONS"),
        ("heading", "PART IV", "STUFF"),
        ("paragraph_numbering", "L.4.2", "VOLUMES"),
        ("role_title", "SOW", "STATEMENT OF WORK"),
    ]
    assert rows[2].components == [4, 2]


def test_long_titles_are_no_headings(spark):
    assert candidates(spark, "SECTION L " + "X" * 130) == []


def test_toc_and_starts(spark):
    toc = "\n".join(f"SECTION {c} - TITLE {c} ..... {i}" for i, c in enumerate("ABCLM", 1))
    pages = [(1, toc)] + [(n, f"page {n}") for n in range(2, 10)] + [(10, "SECTION L - INSTRUCTIONS\nL.1 General\ntext"), (12, "L.4 More\nL.4.2 Deep"), (15, "SECTION M - EVALUATION"), (20, "end")]
    rows = {r.label: r for r in tree(spark, pages).collect()}
    assert (rows["L"].unit_start, rows["L"].unit_end, rows["L"].role) == (10, 14, "instructions")
    assert (rows["M"].unit_start, rows["M"].unit_end) == (15, 20)
    assert (rows["L.1"].unit_start, rows["L.1"].unit_end) == (10, 11)
    assert (rows["L.4"].unit_end, rows["L.4.2"].unit_end) == (14, 14)
    assert rows["L.4.2"].parent_id == rows["L.4"].node_id and rows["L.4"].parent_id == rows["L"].node_id
    order = [r.label for r in sorted(rows.values(), key=lambda r: r.dfs_ord)]
    assert order == ["L", "L.1", "L.4", "L.4.2", "M"]


def test_references_are_no_sections(spark):
    assert tree(spark, [(1, "SECTION L of this solicitation\nSECTION F.\nSection F, at no cost")]).count() == 0


def test_role_titles_only_without_letters(spark):
    rows = tree(spark, [(1, "Statement of Work\nx"), (3, "Evaluation Factors for Award")]).orderBy("unit_start").collect()
    assert [(r.label, r.unit_start, r.unit_end, r.detection) for r in rows] == [("SOW", 1, 2, "role_title"), ("EVALUATION", 3, 3, "role_title")]


def test_start_choice_is_the_last_before_another_letter(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        occ = sorted({(rng.randint(1, 30), rng.randint(0, 9), rng.choice("CLM")) for _ in range(9)})
        occ = list({(u, i): (u, i, c) for u, i, c in occ}.values())
        df = spark.createDataFrame([("f", u, i, c, "heading", c, "T") for u, i, c in occ], "file_id string, unit int, line_index int, letter string, signal string, label string, title string")
        got = {r.letter: (r.unit, r.line_index) for r in s.section_starts(df).collect()}
        for letter in {c for *_, c in occ}:
            mine = [(u, i) for u, i, c in occ if c == letter]
            good = [p for p in mine if any(c != letter and (u, i) > p for u, i, c in occ)]
            assert got[letter] == (good[-1] if good else mine[0])


def test_blocks(spark):
    rows = [("d", 0, "paragraph", "SECTION L - INSTRUCTIONS"), ("d", 1, "paragraph", "L.1 First"), ("d", 2, "table", "SECTION M"), ("d", 3, "paragraph", "SECTION M - EVALUATION ..... 4"), ("d", 4, "paragraph", None)]
    df = spark.createDataFrame(rows, "file_id string, ordinal int, kind string, text string")
    assert sorted((r.label, r.unit_start, r.unit_end, r.kind) for r in s.block_section_tree(df).collect()) == [("L", 0, 4, "blocks"), ("L.1", 1, 4, "blocks")]


FILE = "file_id string, filename string, file_type string, parse_status string, page1_text string, page1_quality string, layout_text string"


def test_roles(spark):
    rows = [
        ("a", "x.pdf", "pdf", "ok", "Amendment of Solicitation / Modification of Contract\nAmendment/Modification No. 0003", "ok", None),
        ("b", "pkg/amend_01.pdf", "pdf", "ok", "", "scanned", None),
        ("c", "base.pdf", "pdf", "ok", "SOLICITATION, OFFER  AND AWARD", "ok", None),
        ("d", "model.pdf", "pdf", "ok", "hello", "ok", "combined synopsis/solicitation"),
        ("e", "note.pdf", "pdf", "ok", "hello", "ok", None),
        ("f", "bad.pdf", "pdf", "failed", None, None, None),
    ]
    got = {r.file_id: (r.doc_role, r.amendment_evidence, r.amendment_number) for r in classify.doc_roles(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {"a": ("amendment", "form_text", "0003"), "b": ("amendment", "filename", None), "c": ("base_solicitation", None, None), "d": ("base_solicitation", None, None), "e": ("attachment", None, None), "f": (None, None, None)}


def package(spark, pages, forms=(None,)):
    files = spark.createDataFrame([("p", i, "f" if i == 0 else f"f{i}", f"f{i}.pdf", f, "text", None) for i, f in enumerate(forms)], "package_name string, file_ord int, file_id string, filename string, form string, form_source string, synopsis string")
    return classify.package_class(files, tree(spark, pages)).first()


def test_package_classes(spark):
    full = [(1, "SECTION C - WORK"), (2, "SECTION L - HOW"), (3, "SECTION M - WHY")]
    assert package(spark, full).classification == "full_ucf"
    assert package(spark, [(1, "SECTION C - WORK"), (2, "SECTION M - WHY"), (3, "SECTION L - HOW")]).classification == "partial_ucf"
    row = package(spark, [(1, "SECTION L - HOW")], ("sf33",))
    assert row.classification == "partial_ucf" and len(row.warnings) == 2 and row.evidence[0] == "SF33 title matched on f0.pdf page 1"
    assert package(spark, [(1, "x")], ("sf1449",)).classification == "non_ucf_commercial"
    assert package(spark, [(1, "x")]).classification == "unknown"
