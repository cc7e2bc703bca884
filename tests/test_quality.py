from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.operators import quality as q

PAGE = "file_id string, page_number int, text string, char_count int, metrics map<string,double>"


def pages(spark, rows):
    return spark.createDataFrame([(f, n, t, len(t) if t is not None else 0, m) for f, n, t, m in rows], PAGE)


def test_gate_order(spark):
    rows = [
        ("f", 1, "", {"has_images": 1.0}),
        ("f", 2, "short", None),
        ("f", 3, "word " * 20, {"has_images": 1.0}),
        ("f", 4, "#" * 200, None),
        ("f", 5, "(cid:12)" * 5 + "letters " * 20, None),
        ("f", 6, "letters " * 20 + "�" * 6, None),
        ("f", 7, "letters " * 40, None),
    ]
    got = {r.page_number: r.quality for r in q.classify_pages(pages(spark, rows)).collect()}
    assert got == {1: "scanned", 2: "empty", 3: "low_text", 4: "gibberish", 5: "gibberish", 6: "gibberish", 7: "ok"}


def test_given_metrics_win(spark):
    row = q.classify_pages(pages(spark, [("f", 1, "letters " * 40, {"alpha_ratio": 0.1})])).first()
    assert row.quality == "gibberish" and row.metrics["alpha_ratio"] == 0.1 and row.metrics["cid_count"] == 0.0


def test_running_lines_are_stripped_at_edges_only(spark):
    body = [f"line {chr(97 + i)} of the body" for i in range(8)]
    rows = [("f", n, "\n".join(["ACME Header", *(body if n != 5 else [*body[:4], "ACME Header", *body[4:]]), f"extra {chr(96 + n)}", f"Page {n} of 10"]), None) for n in range(1, 11)]
    df = q.classify_pages(pages(spark, rows))
    running = q.running_lines(df)
    assert {r.key for r in running.collect()} >= {"ACME HEADER", "PAGE OF"}
    texts = {r.page_number: r.text for r in q.strip_running(df, running).collect()}
    assert "Page" not in texts[3] and not texts[3].startswith("ACME") and "ACME Header" in texts[5]


def test_two_pages_make_every_edge_line_a_running_one(spark):
    df = pages(spark, [("f", 1, "only here\nx", None), ("f", 2, "other\ny", None)])
    assert {r.key for r in q.running_lines(df).collect()} == {"ONLY HERE", "X", "OTHER", "Y"}


def test_one_page_has_no_running_lines(spark):
    assert q.running_lines(pages(spark, [("f", 1, "a\nb", None)])).count() == 0


def test_flagged_pages_are_blank(spark):
    done, _ = q.apply_quality(pages(spark, [("f", 1, "#" * 300, None), ("f", 2, "letters and words " * 10, None), ("f", 3, None, None)]))
    got = {r.page_number: (r.quality, r.text) for r in done.collect()}
    assert got[1] == ("gibberish", "") and got[2][0] == "ok" and got[3][0] == "empty"


def test_ranges(spark):
    df = spark.createDataFrame([("f", n, s) for n, s in enumerate(["ok", "empty", "empty", "scanned", "ok", "empty"], 1)], "file_id string, page_number int, quality string")
    got = sorted((r.first_page, r.last_page, r.quality) for r in q.quality_ranges(df).collect())
    assert got == [(2, 3, "empty"), (4, 4, "scanned"), (6, 6, "empty")]


def test_empty_tables(spark):
    df = pages(spark, [])
    done, running = q.apply_quality(df)
    assert done.count() == running.count() == q.quality_ranges(done).count() == 0


def test_very_long_pages(spark):
    text = ("Some words shall stand here, 12 of them.\n" * 8000) + "x" * 50_000
    row = q.page_metrics(pages(spark, [("f", 1, text, None)])).first()
    assert 0.5 < row.alpha_ratio < 1 and row.printable_ratio == 1.0 and row.cid_count == 0
    done, _ = q.apply_quality(pages(spark, [("f", 1, text, None), ("f", 2, text + "\nend", None)]))
    assert done.where("quality = 'ok'").count() == 2
