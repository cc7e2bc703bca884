"""The stages of the corpus pipeline, each against brute force on what it gets."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import brute  # noqa: E402


def test_stages(spark, tmp_path):
    from .test_scores import toxic_corpus
    from .test_search import corpus

    toxic, labels = toxic_corpus(300)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, t) for i, t in toxic] + [(1000 + i, t) for i, t in corpus(60)] + [(2000 + i, f"own{i} " * 30 + passage + f" tail{i}" * 25) for i in range(3)]
    item = " ".join(f"bench{i}" for i in range(20))
    other = " ".join(f"other{i}" for i in range(20))
    rows += [(3000, item + " x" * 10), (3001, "clean and alone in the corpus " * 3), (3002, " ".join(f"far{i}" for i in range(900)) + " " + other)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in seen.collect()]
        out = stage(spark, seen, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        seen = spark.read.parquet(f"{folder}/{k}")
        after = {r.doc_id: r for r in seen.collect()}
        if name == "toxicity":
            bad = {i for i, _, t in labels if t}
            assert len(bad - set(after)) > 0.95 * len(bad) and len(set(after)) >= len(before) - len(bad) - 2
        elif name == "near_dedup":
            assert sorted(after) == sorted(min(g) for g in brute.near_classes(before))
        elif name == "substring_dedup":
            gone = {k: n for k, _, n, _ in brute.repeats(before)}
            assert set(after) == set(gone) and all(len(brute.words(t)) - gone[i] == len(brute.words(after[i].text)) for i, t in before)
            assert all("\n" in after[i].text for i, t in before if t and t.count("\n") > 40 and len(brute.words(after[i].text)) > 40)
            assert all(r.n_chars == len(r.text or "") or r.text is None for r in after.values())
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute.contamination(before, [(1, item), (2, other)]) if not r[2]} and 3000 not in after and 3002 not in after and 3001 in after
        else:
            assert set(after) == {i for i, _ in before} and all(r.ids is not None for r in after.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(after)


def test_nulls_clashes_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, fp int, score int, class_id int, _n int"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, words, None, "a", 9), (2, words, None, "a", 9), (2, "another text of the key " + words[::-1], "en", None, 9), (None, words + " more", "en", "a", 9), (7, "x" * 200_000 + " end", "en", "b", 9)]
    for k, some in enumerate((rows, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in some], schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        seen = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, folder)
            assert seen.schema == spark.read.parquet(f"{folder}/documents.parquet").schema, name
        got = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
        # the empty text, the passage once, the key's other text, the long one
        assert sorted(got, key=lambda x: x or 0) == ([1, 2, 2, 7] if some else [])
