"""Registered queries over all rows of their tables, against brute force."""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict

import pytest
from test_pipeline import greedy

from tenderlake.functions.fuzzy import token_set_ratio
from tenderlake.plans import catalogue
from tenderlake.sources import adapters as ad

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def query(spark, name, sf_dir=SMALL):
    return catalogue.queries()[name](spark, sf_dir)


def test_cross_map_has_every_requirement_under_its_factor(spark):
    rows = ad.solicitation_requirements(spark, SMALL).collect()
    factor = {r.requirement_id: r.factor for r in query(spark, "q_assign_factors").collect()}
    side = {r.requirement_id: {"instruction": "L", "evaluation": "M"}.get(r.req_type, "C") for r in rows}
    meets = {"L": "M", "M": "L", "C": "LM"}
    want = {}
    for a in rows:
        i = a.requirement_id
        pool = [b for b in rows if side[b.requirement_id] in meets[side[i]] and not (factor.get(i) and factor.get(b.requirement_id) and factor[i] != factor[b.requirement_id])]
        scores = [s for s in (token_set_ratio(a.verbatim_text, b.verbatim_text) for b in pool) if s >= 55.0]
        gap = {"L": "l_without_m", "M": "m_without_l" if factor.get(i) else "evaluation_process", "C": "sow_without_either"}[side[i]]
        want[i] = ("mapped" if scores else gap, len(scores), round(max(scores, default=0.0), 6))
    got = query(spark, "q_crossmap_fuzzy").collect()
    assert len(got) == len(rows) and {r.requirement_id: (r.gap_kind, r.counterparts, r.score) for r in got} == want


def test_sweep_goes_by_the_page_over_all_files(spark):
    rows = ad.solicitation_requirements(spark, SMALL).collect()
    hits = sorted((h.file_id, h.page, h.hit_idx, h.sentence, h.binding_keyword) for h in query(spark, "q_sweep_hits").collect())
    first, covered = {}, set()
    for r in rows:
        for file_id, page, i, sentence, word in hits:
            if page == r.page and (r.verbatim_text in sentence or sentence in r.verbatim_text):
                first.setdefault(r.requirement_id, (word, file_id, r.file_id))
                if r.req_type != "evaluation":
                    covered.add((file_id, page, i))
    assert any(here != of for _, here, of in first.values())
    assert {r.requirement_id: r.binding_keyword for r in query(spark, "q_reconcile").collect()} == {r.requirement_id: first.get(r.requirement_id, ("none",))[0] for r in rows}
    assert {r.requirement_id for r in query(spark, "q_over_extracted").collect()} == {r.requirement_id for r in rows} - set(first)
    assert {(r.file_id, r.page, r.hit_idx) for r in query(spark, "q_missed").collect()} == {h[:3] for h in hits} - covered


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the test tables")
def test_chunks_are_all_windows_of_all_nodes(spark):
    pages = defaultdict(dict)
    for p in ad.solicitation_pages(spark, LARGE).collect():
        pages[p.file_id][p.page_number] = p.text
    nodes = defaultdict(list)
    for n in catalogue._tree(spark, LARGE).collect():
        nodes[n.file_id].append((n.dfs_ord, n.label or n.role or f"{n.file_id}.pdf", n.unit_start, n.unit_end))
    want = []
    for file_id, texts in pages.items():
        for dfs_ord, label, low, high in nodes.get(file_id, [(0, f"{file_id}.pdf", min(texts), max(texts))]):
            mine = [texts[p] for p in sorted(texts) if low <= p <= high]
            for i, (a, b) in enumerate(greedy([len(t) for t in mine], 24_000)):
                text = re.sub(r"\s+", " ", re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", "\n".join(mine[a : b + 1]))).strip()
                want.append((file_id, dfs_ord, i, label, b - a + 1, "CHK-" + hashlib.sha256(text.encode()).hexdigest()[:12]))
    got = [tuple(r) for r in query(spark, "q_chunk_windows", LARGE).collect()]
    assert any(r[2] > 0 for r in want) and sorted(got) == sorted(want)
