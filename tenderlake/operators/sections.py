"""Headings, tables of contents and the section tree, as rows of nodes.

A heading candidate has a position (unit, line): the unit is a page or a block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import heading_fold
from .quality import page_lines

# Titles of sections by role, in order of precedence; labels of role-only
# nodes; roles that section letters have by custom; words that no title starts with.
ROLE_TITLES = {
    "INSTRUCTIONS, CONDITIONS, AND NOTICES TO OFFERORS": "instructions",
    "EVALUATION FACTORS FOR AWARD": "evaluation",
    "STATEMENT OF WORK": "sow_pws",
    "PERFORMANCE WORK STATEMENT": "sow_pws",
    "SPECIAL CONTRACT REQUIREMENTS": "special_requirements",
    "PROPOSAL SUBMISSION INSTRUCTIONS": "instructions",
}
ROLE_LABELS = {"instructions": "INSTRUCTIONS", "evaluation": "EVALUATION", "sow_pws": "SOW", "special_requirements": "SPECIAL REQS"}
LETTER_ROLES = {"C": "sow_pws", "H": "special_requirements", "I": "clauses", "J": "attachments_list", "L": "instructions", "M": "evaluation"}
PROSE_STARTS = (
    ",", "OF", "IS", "ARE", "WAS", "WERE", "WILL", "SHALL", "MAY", "MUST", "CAN", "COULD", "SHOULD", "WOULD", "DO", "DOES", "DID", "HAS", "HAVE", "HEREBY",
    "BEING", "BEEN", "ABOVE", "BELOW", "AND", "OR", "NOR", "BUT", "TO", "IN", "UNDER", "WITHIN", "WITHOUT", "THAT", "WHICH", "THEREOF", "THEREIN", "THERETO",
    "HEREIN", "HEREOF", "HERETO", "HEREUNDER", "ENTITLED",
)


@dataclass(frozen=True)
class Headings:
    """Patterns (of folded lines) and limits of heading detection."""

    # How section, part and paragraph headings look, and lines of a table of contents.
    section: str = r"(?i)^\s*SECTION\s+([A-M])\b\s*[—–\-:]?\s*(.{0,120})$"
    part: str = r"(?i)^\s*PART\s+(I{1,3}|IV)\b\s*[—–\-:.]?\s*(.{0,80})$"
    paragraph: str = r"^\s*([A-M])((?:\.\d{1,4}){1,6})\b"
    toc_tail: str = r"(?U)(\.{3,}\s*\d{1,4}|\s\d{1,4})\s*$"
    citation: str = r"(?U)^(?:\W*$|[.,;])"
    prose: str = rf"(?U)^(?:{'|'.join(PROSE_STARTS)})\b"
    toc_letters: int = 4
    leading_lines: int = 10
    role_titles: dict[str, str] = field(default_factory=lambda: dict(ROLE_TITLES))
    role_labels: dict[str, str] = field(default_factory=lambda: dict(ROLE_LABELS))
    letter_roles: dict[str, str] = field(default_factory=lambda: dict(LETTER_ROLES))


HEADINGS = Headings()


def _role(line: Column, rules: Headings, at_start: bool) -> Column:
    out = F.lit(None).cast("string")
    for title, role in reversed(rules.role_titles.items()):
        hit = (line == title) | line.startswith(f"{title} ") if at_start else line.contains(title)
        out = F.when(hit, role).otherwise(out)
    return out


def role_in_title(line: Column, rules: Headings = HEADINGS) -> Column:
    """The role of the first known title that the folded line holds anywhere, or null."""
    return _role(line, rules, False)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def heading_candidates(lines: DataFrame, rules: Headings = HEADINGS) -> DataFrame:
    """Of lines (file_id, unit, line_index, line), those that look like a heading, with one signal each:
    (file_id, unit, line_index, signal, label, title, letter, components, role)."""
    line = F.col("_folded")
    # generated, so that the fold is not copied into each of the expressions that read it
    rows = lines.withColumn("_folded", F.explode(F.array(heading_fold(F.col("line"))))).where(line != "")
    is_section, is_part, is_paragraph = (line.rlike(p) for p in (rules.section, rules.part, rules.paragraph))
    role = _role(line, rules, True)
    pick = lambda section, part, paragraph, title: F.when(is_section, section).when(is_part, part).when(is_paragraph, paragraph).otherwise(title)
    group = lambda pattern, k: F.regexp_extract(line, pattern, k)
    null = F.lit(None).cast("string")
    title = F.trim(group(rules.section, 2))
    tail = group(rules.paragraph, 2)
    rest = F.trim(F.regexp_replace(line, rules.paragraph, ""))
    numbers = F.transform(F.split(F.substring(tail, 2, 100), r"\."), lambda x: x.cast("int"))
    out = rows.where(is_section | is_part | is_paragraph | role.isNotNull())
    return out.select(
        "file_id",
        "unit",
        "line_index",
        pick(F.lit("heading"), F.lit("heading"), F.lit("paragraph_numbering"), F.lit("role_title")).alias("signal"),
        pick(F.upper(group(rules.section, 1)), F.concat(F.lit("PART "), F.upper(group(rules.part, 1))), F.concat(group(rules.paragraph, 1), tail), _lookup(role, rules.role_labels)).alias("label"),
        pick(title, F.trim(group(rules.part, 2)), rest, line).alias("title"),
        pick(F.upper(group(rules.section, 1)), null, group(rules.paragraph, 1), null).alias("letter"),
        F.when(~is_section & ~is_part & is_paragraph, numbers).alias("components"),
        pick(_role(title, rules, False), null, null, role).alias("role"),
    )


def pages_as_lines(pages: DataFrame) -> DataFrame:
    return page_lines(pages).withColumnRenamed("page_number", "unit")


def toc_pages(candidates: DataFrame, rules: Headings = HEADINGS) -> DataFrame:
    """(file_id, unit) of pages with many letters, or two and most with page numbers behind them."""
    letters = candidates.where("signal = 'heading' and letter is not null")
    found = letters.groupBy("file_id", "unit").agg(F.countDistinct("letter").alias("letters"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("title").rlike(rules.toc_tail)).alias("tails"))
    return found.where((F.col("letters") >= rules.toc_letters) | ((F.col("n") >= 2) & (F.col("tails") * 2 > F.col("n")))).select("file_id", "unit")


def without_references(candidates: DataFrame, rules: Headings = HEADINGS) -> DataFrame:
    """Candidates that are no citations or sentences about a section."""
    title = F.col("title")
    citing = ((F.col("signal") == "heading") & title.rlike(rules.citation)) | title.rlike(rules.prose)
    return candidates.where(F.col("letter").isNull() | ~citing)


def section_starts(headings: DataFrame) -> DataFrame:
    """The heading that starts each letter of a file: the last one with another letter after it, else the first.

    The greatest position of other letters is that of the file, or the second letter's
    where the greatest is the letter's own; so no two occurrences are ever compared.
    """
    pos = F.struct("unit", "line_index")
    letters = headings.where("letter is not null").withColumn("pos", pos)
    last = letters.groupBy("file_id", "letter").agg(F.max("pos").alias("last"))
    by_last = Window.partitionBy("file_id").orderBy(F.desc("last"))
    top = last.withColumn("_n", F.row_number().over(by_last)).where("_n <= 2").groupBy("file_id").agg(F.max_by("letter", "last").alias("top_letter"), F.max("last").alias("top"), F.max(F.when(F.col("_n") == 2, F.col("last"))).alias("second"))
    rows = letters.join(top, "file_id").withColumn("other", F.when(F.col("letter") == F.col("top_letter"), F.col("second")).otherwise(F.col("top")))
    chosen = rows.groupBy("file_id", "letter").agg(F.coalesce(F.max(F.when(F.col("pos") < F.col("other"), F.col("pos"))), F.min("pos")).alias("pos"))
    return letters.join(chosen, ["file_id", "letter", "pos"]).drop("pos")


def spans(starts: DataFrame, last_units: DataFrame) -> DataFrame:
    """starts with unit_start and unit_end: up to the unit before the next start, the last one to the file's end."""
    order = Window.partitionBy("file_id").orderBy("unit", "line_index")
    end = F.coalesce(F.lead("unit").over(order) - 1, F.col("last_unit"), F.col("unit"))
    return starts.join(last_units, "file_id", "left").withColumn("unit_start", F.col("unit")).withColumn("unit_end", F.greatest(end, F.col("unit"))).drop("last_unit")


def paragraph_nodes(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraph headings inside their letter's section, nested by the depth of their numbers.

    A paragraph ends before the next one of its depth or less; its parent is the nearest
    one before it of less depth. Each depth is looked at once per row through windows, so
    a section's paragraphs never meet pairwise.
    """
    section = sections.select("file_id", "letter", F.col("node_id").alias("section_id"), F.col("unit_start").alias("_from"), F.col("line_index").alias("_line"), F.col("unit_end").alias("_to"))
    rows = paragraphs.join(section, ["file_id", "letter"]).where((F.struct("unit", "line_index") >= F.struct("_from", "_line")) & (F.col("unit") <= F.col("_to")))
    rows = rows.withColumn("depth", F.size("components")).withColumn("node_id", F.concat_ws("/", "section_id", F.format_string("%08d.%05d", "unit", "line_index")))
    ahead = Window.partitionBy("file_id", "section_id").orderBy("unit", "line_index").rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy("file_id", "section_id").orderBy("unit", "line_index").rowsBetween(Window.unboundedPreceding, -1)
    # numbers have six components at most
    stop, parent = F.lit(None).cast("int"), F.lit(None).cast("string")
    for d in range(1, 7):
        next_unit = F.first(F.when(F.col("depth") <= d, F.col("unit")), ignorenulls=True).over(ahead)
        stop = F.when(F.col("depth") == d, next_unit).otherwise(stop)
        before = F.last(F.when(F.col("depth") < d, F.col("node_id")), ignorenulls=True).over(behind)
        parent = F.when(F.col("depth") == d, before).otherwise(parent)
    rows = rows.withColumn("_stop", stop).withColumn("parent_id", F.coalesce(parent, F.col("section_id")))
    # a child ends no later than its parents do: ends before the next row of less or equal depth, which bounds parents too
    return rows.withColumn("unit_start", F.col("unit")).withColumn("unit_end", F.greatest(F.coalesce(F.col("_stop") - 1, F.col("_to")), F.col("unit")))


NODE = ["file_id", "node_id", "parent_id", "depth", "label", "title", "role", "unit_start", "unit_end", "line_index", "detection"]


def _tree(headings: DataFrame, roles: DataFrame, paragraphs: DataFrame, last_units: DataFrame, rules: Headings) -> DataFrame:
    name = F.concat_ws("/", "file_id", F.format_string("%08d.%05d", "unit", "line_index"))
    letters = spans(section_starts(headings), last_units).withColumn("node_id", name)
    letters = letters.withColumn("role", F.coalesce("role", _lookup(F.col("letter"), rules.letter_roles)))
    none = F.lit(None).cast("string")
    top = letters.select("file_id", "node_id", none.alias("parent_id"), F.lit(0).alias("depth"), "label", "title", "role", "unit_start", "unit_end", "line_index", F.lit("heading").alias("detection"))
    inner = paragraph_nodes(letters, paragraphs).withColumn("role", none).withColumn("detection", F.lit("paragraph_numbering")).select(*NODE)
    only = roles.join(letters.select("file_id").distinct(), "file_id", "left_anti")
    only = spans(only, last_units).withColumn("node_id", name).select("file_id", "node_id", none.alias("parent_id"), F.lit(0).alias("depth"), "label", "title", "role", "unit_start", "unit_end", "line_index", F.lit("role_title").alias("detection"))
    nodes = top.unionByName(inner).unionByName(only)
    # a node's id begins with its section's, then positions: their order is depth first
    order = Window.partitionBy("file_id").orderBy("node_id")
    return nodes.withColumn("dfs_ord", F.row_number().over(order) - 1)


def section_tree(pages: DataFrame, files: DataFrame | None = None, rules: Headings = HEADINGS) -> DataFrame:
    """Nodes of paged files: pages (file_id, page_number, text); files may give page_count."""
    found = heading_candidates(pages_as_lines(pages), rules)
    found = without_references(found.join(toc_pages(found, rules), ["file_id", "unit"], "left_anti"), rules)
    leading = F.col("line_index") < rules.leading_lines
    last = pages.groupBy("file_id").agg(F.max("page_number").alias("_seen"))
    if files is not None:
        last = last.join(files.select("file_id", "page_count"), "file_id", "left").withColumn("_seen", F.coalesce(F.nullif("page_count", F.lit(0)), "_seen"))
    last = last.select("file_id", F.col("_seen").alias("last_unit"))
    nodes = _tree(found.where((F.col("signal") == "heading") & leading), found.where((F.col("signal") == "role_title") & leading), found.where("signal = 'paragraph_numbering'"), last, rules)
    return nodes.withColumn("kind", F.lit("pages"))


def block_section_tree(blocks: DataFrame, rules: Headings = HEADINGS) -> DataFrame:
    """Nodes of files made of blocks: blocks (file_id, ordinal, kind, text); only paragraphs carry headings."""
    texts = blocks.where("kind = 'paragraph' and text <> ''").select("file_id", F.col("ordinal").alias("page_number"), "text")
    found = without_references(heading_candidates(pages_as_lines(texts), rules), rules).where(~F.col("title").rlike(rules.toc_tail))
    last = blocks.groupBy("file_id").agg(F.max("ordinal").alias("last_unit"))
    nodes = _tree(found.where("signal = 'heading'"), found.where("signal = 'role_title'"), found.where("signal = 'paragraph_numbering'"), last, rules)
    return nodes.withColumn("kind", F.lit("blocks"))
