"""Scoring predictions against golden rows: precision, recall and F1 with one-to-one matches."""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fuzzy import token_set_similarity
from ..functions.text import golden_id, normalize

THRESHOLD = 90.0
KEYWORDS = ("shall", "must", "will", "should", "shall not", "none")


def _classes(rows: DataFrame, name: str) -> DataFrame:
    """(file_id, page, _<name>, <name>_ords): rows of one page and text, by their ordinals."""
    folded = rows.where("file_id is not null and page is not null").select(f"{name}_ord", "file_id", "page", normalize(F.col("verbatim_text")).alias(f"_{name}"))
    return folded.groupBy("file_id", "page", f"_{name}").agg(F.sort_array(F.collect_list(f"{name}_ord")).alias(f"{name}_ords"))


def _alike(p: DataFrame, g: DataFrame, threshold: float, similarity) -> DataFrame:
    """(file_id, page, _pred, _gold, sim) of texts on one page that are similar enough; a pair of texts is compared once for all pages."""
    met = p.select("file_id", "page", "_pred").join(g.select("file_id", "page", "_gold"), ["file_id", "page"])
    sims = met.select("_pred", "_gold").distinct().withColumn("sim", similarity(F.col("_pred"), F.col("_gold"))).where(F.col("sim") >= threshold)
    return met.join(sims, ["_pred", "_gold"])


def match_pairs(preds: DataFrame, golds: DataFrame, threshold: float = THRESHOLD, similarity=token_set_similarity) -> DataFrame:
    """(pred_ord, gold_ord, file_id, page, sim) of pairs on one page of one file that are similar enough.

    preds and golds (pred_ord or gold_ord, file_id, page, verbatim_text); a row without a page matches nothing.
    """
    p, g = _classes(preds, "pred"), _classes(golds, "gold")
    pairs = _alike(p, g, threshold, similarity).join(p, ["file_id", "page", "_pred"]).join(g, ["file_id", "page", "_gold"])
    ones = pairs.select(F.explode("pred_ords").alias("pred_ord"), "gold_ords", "file_id", "page", "sim")
    return ones.select("pred_ord", F.explode("gold_ords").alias("gold_ord"), "file_id", "page", "sim")


def _pick(pairs: list[tuple[int, int, float]], preds: dict[int, list[int]], golds: dict[int, list[int]]) -> list[tuple[int, int, float]]:
    """Greedy matches by (most similar, first prediction, first golden row) from pairs of classes; ordinals are taken from the lists."""
    levels: dict[float, dict[int, list[int]]] = {}
    for p, g, sim in pairs:
        levels.setdefault(sim, {}).setdefault(p, []).append(g)
    free = {k: list(reversed(v)) for k, v in golds.items()}
    kept = []
    for sim in sorted(levels, reverse=True):
        met = levels[sim]
        queue = [(v[0], p, 0) for p in met if (v := preds[p])]
        heapq.heapify(queue)
        gone: dict[int, set[int]] = {}
        while queue:
            ord_, p, at = queue[0]
            met[p] = [g for g in met[p] if free[g]]
            if not met[p]:
                # no golden row is left for this text, nor for what follows it
                heapq.heappop(queue)
                continue
            g = min(met[p], key=lambda k: free[k][-1])
            kept.append((ord_, free[g].pop(), sim))
            gone.setdefault(p, set()).add(ord_)
            if at + 1 < len(preds[p]):
                heapq.heapreplace(queue, (preds[p][at + 1], p, at + 1))
            else:
                heapq.heappop(queue)
        for p, out in gone.items():
            preds[p] = [x for x in preds[p] if x not in out]
    return kept


_PICKED = pa.schema([("pred_ord", pa.int64()), ("gold_ord", pa.int64()), ("sim", pa.float64())])


def _pick_page(pairs: pa.Table, members: pa.Table) -> pa.Table:
    sides: tuple[dict, dict] = ({}, {})
    for gold, key, ords in zip(*(members.column(c).to_pylist() for c in ("_is_gold", "_key", "_ords"))):
        sides[gold][key] = ords
    kept = _pick(list(zip(*(pairs.column(c).to_pylist() for c in ("_p", "_g", "sim")))), *sides)
    return pa.Table.from_arrays([pa.array([k[i] for k in kept], f.type) for i, f in enumerate(_PICKED)], schema=_PICKED)


def matches(preds: DataFrame, golds: DataFrame, threshold: float = THRESHOLD, similarity=token_set_similarity) -> DataFrame:
    """(pred_ord, gold_ord, sim): as assign of match_pairs, from pairs of texts on a page, so that equal rows aren't paired with each other."""
    p, g = _classes(preds, "pred"), _classes(golds, "gold")
    named = lambda rows, name: rows.select("file_id", "page", f"_{name}", F.get(f"{name}_ords", F.lit(0)).cast("long").alias(f"_{name[0]}"))
    pairs = _alike(p, g, threshold, similarity).join(named(p, "pred"), ["file_id", "page", "_pred"]).join(named(g, "gold"), ["file_id", "page", "_gold"]).select("file_id", "page", "_p", "_g", "sim")
    member = lambda rows, name, gold: rows.select(F.col("file_id").alias("_file"), F.col("page").alias("_page"), F.lit(gold).alias("_is_gold"), F.get(f"{name}_ords", F.lit(0)).cast("long").alias("_key"), F.col(f"{name}_ords").cast("array<long>").alias("_ords"))
    members = member(p, "pred", 0).unionByName(member(g, "gold", 1))
    return pairs.groupBy("file_id", "page").cogroup(members.groupBy("_file", "_page")).applyInArrow(_pick_page, "pred_ord long, gold_ord long, sim double")


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    preds: set[int] = set()
    golds: set[int] = set()
    kept = []
    for row in rows.sort_values(["sim", "pred_ord", "gold_ord"], ascending=[False, True, True]).itertuples():
        if row.pred_ord not in preds and row.gold_ord not in golds:
            preds.add(row.pred_ord)
            golds.add(row.gold_ord)
            kept.append((row.pred_ord, row.gold_ord, row.sim))
    return pd.DataFrame(kept, columns=["pred_ord", "gold_ord", "sim"])


def assign(pairs: DataFrame) -> DataFrame:
    """(pred_ord, gold_ord, sim): greedy by similarity, each side once.

    Pairs never leave their page, so pages are independent groups; a group is a page's
    candidates, which its text bounds.
    """
    return pairs.groupBy("file_id", "page").applyInPandas(_greedy, "pred_ord long, gold_ord long, sim double")


def in_footprint(preds: DataFrame, golds: DataFrame, inside: bool = True) -> DataFrame:
    """Predictions on (or off) the pages that golden rows are on; null pages count as a page of their file."""
    spots = golds.select(F.col("file_id").alias("_f"), F.col("page").alias("_g")).distinct()
    on = preds["file_id"].eqNullSafe(spots["_f"]) & preds["page"].eqNullSafe(spots["_g"])
    return preds.join(spots, on, "left_semi" if inside else "left_anti")


def rates(matched: Column, preds: Column, golds: Column) -> dict[str, Column]:
    precision = F.coalesce(F.try_divide(matched, preds), F.lit(0.0))
    recall = F.coalesce(F.try_divide(matched, golds), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def score(preds: DataFrame, golds: DataFrame, threshold: float = THRESHOLD, scoped: bool = True, similarity=token_set_similarity) -> DataFrame:
    """One row: precision, recall, f1, matched, total_preds, total_golds, out_of_scope."""
    inside = in_footprint(preds, golds) if scoped else preds
    matched = matches(inside, golds, threshold, similarity)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(matched, "matched").join(n(inside, "total_preds")).join(n(golds, "total_golds")).join(n(preds, "_all"))
    one = one.withColumn("out_of_scope", F.col("_all") - F.col("total_preds")).drop("_all")
    return one.withColumns(rates(F.col("matched"), F.col("total_preds"), F.col("total_golds")))


def unmatched(preds: DataFrame, golds: DataFrame, threshold: float = THRESHOLD, scoped: bool = True, similarity=token_set_similarity) -> tuple[DataFrame, DataFrame]:
    """(predictions, golden rows) that found no partner."""
    inside = in_footprint(preds, golds) if scoped else preds
    matched = matches(inside, golds, threshold, similarity)
    return inside.join(matched, "pred_ord", "left_anti"), golds.join(matched, "gold_ord", "left_anti")


def score_exhaustive(preds: DataFrame, golds: DataFrame, ranges: DataFrame, threshold: float = THRESHOLD, similarity=token_set_similarity) -> DataFrame:
    """score on declared pages alone; ranges (file_id, pages). No rows where nothing is declared."""
    allowed = ranges.select("file_id", F.explode("pages").alias("page")).distinct()
    result = score(preds.join(allowed, ["file_id", "page"], "left_semi"), golds.join(allowed, ["file_id", "page"], "left_semi"), threshold, False, similarity)
    return result.join(allowed.agg(F.count(F.lit(1)).alias("scope_pages"))).where("scope_pages > 0")


def golden_rows(preds: DataFrame, section: str, req_type: str) -> DataFrame:
    """Predictions as golden rows; keywords that aren't known become none."""
    keyword = F.when(F.col("binding_keyword").isin(*KEYWORDS), F.col("binding_keyword")).otherwise("none")
    return preds.select(golden_id(F.col("verbatim_text"), F.col("atomic_obligation")).alias("requirement_id"), F.lit(section).alias("section"), "file_id", "filename", "page", "verbatim_text", "atomic_obligation", keyword.alias("binding_keyword"), F.lit(req_type).alias("req_type"), F.lit(None).cast("string").alias("parent_id"), F.lit("C").alias("provenance_pass"))


def promote(preds: DataFrame, golds: DataFrame, file_id: str, pages: list[int], section: str, req_type: str, is_requirement: Column, similarity=token_set_similarity) -> tuple[DataFrame, DataFrame]:
    """(promoted golden rows, rejected predictions) of a file's pages: what no golden row matches, split by the predicate.

    Predictions of the file without a page are looked at too.
    """
    mine = F.col("file_id") == file_id
    inside = preds.where(mine & (F.col("page").isNull() | F.col("page").isin(*pages)))
    free, _ = unmatched(inside, golds.where(mine & F.col("page").isin(*pages)), scoped=False, similarity=similarity)
    wanted = F.coalesce(is_requirement, F.lit(False))
    return golden_rows(free.where(wanted), section, req_type), free.where(~wanted)


def unverified_pages(ranges: DataFrame, golds: DataFrame, preds: DataFrame) -> DataFrame:
    """Declared (file_id, page) without golden rows and without predictions."""
    declared = ranges.select("file_id", F.explode("pages").alias("page"))
    return declared.subtract(golds.select("file_id", "page")).subtract(preds.select("file_id", "page"))


def score_line(row) -> str:
    """One line of text about a row of score."""
    # Fixed value: the wording of the line.
    more = f"; {row.out_of_scope} prediction(s) on unannotated pages, not scored" if row.out_of_scope else ""
    return f"vs golden set: precision={row.precision:.3f}, recall={row.recall:.3f}, F1={row.f1:.3f} ({row.matched}/{row.total_golds} golden matched, {row.total_preds} predicted in scope{more})"
