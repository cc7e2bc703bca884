"""Page metrics, the quality gate, and running headers and footers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import header_key, lines


@dataclass(frozen=True)
class Thresholds:
    """Limits of the gate; tune by passing another instance."""

    scanned_chars: int = 20
    low_text_chars: int = 150
    alpha_ratio: float = 0.5
    cid_ratio: float = 0.02
    replacements: int = 5


@dataclass(frozen=True)
class RunningLines:
    """A line at a page's edge is a running one at this share of pages, or this many."""

    share: float = 0.4
    repeats: int = 8
    band: int = 3
    voters: int = 2


METRICS = ("alpha_ratio", "printable_ratio", "cid_count", "replacement_char_count")


def metric(name: str, text: Column) -> Column:
    """One metric of a page's text, 0.0 where there is nothing to divide by."""
    # counted by what is left when all other characters go: one pass, no arrays of matches
    left = lambda pattern: F.length(F.regexp_replace(text, f"(?U){pattern}", ""))
    gone = lambda piece: ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("double")
    return {
        "alpha_ratio": lambda: F.coalesce(F.try_divide(left(r"[^\p{L}]+"), left(r"[\s\x1c-\x1f]+")), F.lit(0.0)),
        "printable_ratio": lambda: F.coalesce(F.try_divide(F.length(text) - left(r"[[^\p{C}\p{Z}]\s\x1c-\x1f]+"), F.length(text)), F.lit(0.0)),
        "cid_count": lambda: gone("(cid:"),
        "replacement_char_count": lambda: gone("�"),
    }[name]()


def page_metrics(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with one column per metric of the text."""
    return pages.withColumns({name: metric(name, F.col(text)) for name in METRICS})


def gate(chars: Column, has_images: Column, alpha: Column, cids: Column, replacements: Column, t: Thresholds = Thresholds()) -> Column:
    """ok, scanned, empty, low_text or gibberish; earlier tests win."""
    images = F.coalesce(has_images, F.lit(False))
    broken = (alpha < t.alpha_ratio) | (cids / F.greatest(chars, F.lit(1)) > t.cid_ratio) | (replacements > t.replacements)
    return F.when(chars < t.scanned_chars, F.when(images, "scanned").otherwise("empty")).when(images & (chars < t.low_text_chars), "low_text").when(broken, "gibberish").otherwise("ok")


def classify_pages(pages: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """pages with quality, and metrics completed: values that parsing set stay."""
    given = F.coalesce(F.col("metrics"), F.create_map().cast("map<string,double>"))
    values = {name: F.coalesce(F.try_element_at(given, F.lit(name)), metric(name, F.col("text"))) for name in METRICS}
    fresh = F.create_map(*[x for name in METRICS for x in (F.lit(name), metric(name, F.col("text")))])
    merged = F.map_concat(F.map_filter(fresh, lambda k, _: ~F.map_contains_key(given, k)), given)
    images = F.try_element_at(given, F.lit("has_images")) > 0
    quality = gate(F.col("char_count"), images, values["alpha_ratio"], values["cid_count"], values["replacement_char_count"], t)
    return pages.withColumn("quality", quality).withColumn("metrics", merged)


def page_lines(pages: DataFrame) -> DataFrame:
    """(file_id, page_number, line_index, n_lines, line) of all pages with text."""
    rows = pages.select("file_id", "page_number", lines(F.col("text")).alias("_lines"))
    rows = rows.select("file_id", "page_number", F.posexplode("_lines").alias("line_index", "line"), F.size("_lines").alias("n_lines"))
    return rows.select("file_id", "page_number", "line_index", "n_lines", "line")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edge_keys(text: Column, rule: RunningLines) -> Column:
    """The distinct keys of a page's first and last lines; digit-only lines have none."""
    band = bound(lines(text), lambda l: F.concat(F.slice(l, 1, rule.band), F.slice(l, -rule.band, rule.band)))
    return F.array_remove(F.array_distinct(F.transform(band, header_key)), "")


def running_lines(pages: DataFrame, rule: RunningLines = RunningLines()) -> DataFrame:
    """(file_id, key, pages): keys of lines that run through a file's page edges; a page votes once per key."""
    # one row per page and key at most, so counting needs no distinct
    votes = pages.select("file_id", F.explode(edge_keys(F.col("text"), rule)).alias("key")).groupBy("file_id", "key").agg(F.count(F.lit(1)).alias("pages"))
    voters = pages.where("text <> ''").groupBy("file_id").agg(F.count(F.lit(1)).alias("voters")).where(F.col("voters") >= rule.voters)
    return votes.join(voters, "file_id").where((F.col("pages") >= rule.share * F.col("voters")) | (F.col("pages") >= rule.repeats)).select("file_id", "key", "pages")


def strip_running(pages: DataFrame, running: DataFrame, rule: RunningLines = RunningLines()) -> DataFrame:
    """pages whose text lacks the running lines of its edges; mid-page lines stay.

    The keys of a file are few (a line has to recur at page edges), so they go to its
    pages as one array and the text is filtered in place, without exploding it.
    """
    keys = running.groupBy("file_id").agg(F.collect_set("key").alias("_keys"))
    at_edge = lambda i, n: (i < rule.band) | (i >= n - rule.band)
    kept = bound(lines(F.col("text")), lambda l: F.filter(l, lambda line, i: ~(at_edge(i, F.size(l)) & F.array_contains(F.col("_keys"), header_key(line)))))
    joined = pages.join(keys, "file_id", "left")
    return joined.withColumn("text", F.when(F.col("_keys").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*pages.columns)


def apply_quality(pages: DataFrame, t: Thresholds = Thresholds(), rule: RunningLines = RunningLines()) -> tuple[DataFrame, DataFrame]:
    """(pages, running lines): gated, texts of pages that aren't ok blanked, running lines stripped."""
    gated = classify_pages(pages, t)
    ok = gated.where("quality = 'ok'")
    running = running_lines(ok, rule)
    blank = gated.withColumn("text", F.when(F.col("quality") == "ok", F.col("text")).otherwise(""))
    return strip_running(blank, running, rule), running


def quality_ranges(pages: DataFrame) -> DataFrame:
    """(file_id, first_page, last_page, quality): runs of pages of one status other than ok."""
    bad = pages.where("quality <> 'ok'")
    run = F.col("page_number") - F.row_number().over(Window.partitionBy("file_id", "quality").orderBy("page_number"))
    return bad.withColumn("_run", run).groupBy("file_id", "quality", "_run").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page")).select("file_id", "first_page", "last_page", "quality")
