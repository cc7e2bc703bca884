from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """In a copy of the tree without their folders; with them, a module that they lack is an error."""
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p and not p.startswith(ROOT))}
    copy = tmp_path / "tree"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    broken = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", broken], cwd=ROOT, env=env, capture_output=True).returncode != 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["q_quality_gate", "q_window_pack", "q_derive_outline", "q_crossmap_fuzzy", "q_ground_fuzzy"])
def test_queries_run(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, SMALL).count() > 0


def test_stream_of_pages(spark, tmp_path):
    from tenderlake.streaming import pages as sp

    rows = [("f", 1, "letters and words " * 10, "2024-01-01 00:00:00"), ("f", 2, "letters  and words " * 10, "2024-01-01 00:01:00"), ("f", 3, "other words to read " * 10, "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "file_id string, page_number int, text string, ts string").selectExpr("file_id", "page_number", "text", "length(text) AS char_count", "cast(null AS map<string,double>) AS metrics", "to_timestamp(ts) AS ts", "'k' AS event_type", "1.0D AS value")
    df.write.parquet(str(tmp_path / "in"))
    stream = sp.page_stream(spark, str(tmp_path / "in"), df._jdf.schema().toDDL())
    for name, out, mode, want in (("fresh", sp.new_content(sp.gated(stream)), "append", 2), ("counts", sp.event_counts(stream), "complete", 1)):
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == want
