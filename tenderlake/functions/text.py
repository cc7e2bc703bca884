"""Text folds, splitters and content ids as Column expressions.

All run inside the JVM but Unicode compatibility normalisation, which Spark has no
function for: an Arrow UDF sees only texts with characters that it could change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

#: White space as the folds see it, for use inside a character class.
WS = r"\s\x1c-\x1f"
_LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ])"
#: Characters that compatibility normalisation leaves alone when they stand by themselves.
_STABLE = r"[^\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff‐‒-‖‘-‟]"


@pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; rows that it can't change never leave the JVM."""
    # the class is slow to test, and never met by ASCII alone
    return F.coalesce(_nfkc(F.when((F.octet_length(text) > F.length(text)) & text.rlike(_STABLE), text)), text)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U)[{WS}]+", " "))


def normalize(text: Column, compose: bool = True) -> Column:
    """The shared fold: compose, heal hyphenated line breaks, collapse white space."""
    text = nfkc(text) if compose else text
    return collapse(F.regexp_replace(text, rf"(?U)(\w)[-­][{WS}]*\n[{WS}]*(\w)", "$1$2"))


def lines(text: Column) -> Column:
    """The lines of a text, without their ends; an end at the very end starts no new line."""
    body = F.regexp_replace(text, _LINE_END + r"\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, _LINE_END))


def header_key(line: Column) -> Column:
    """A line without digits, collapsed, upper case: equal for 'Page 3 of 9' and 'Page 4 of 9'.

    A sharp s stays one letter, so that lines with it and with a double s are told apart.
    """
    return F.upper(collapse(F.translate(line, "ß0123456789", "ẞ")))


def heading_fold(line: Column) -> Column:
    """Dashes as '-', collapsed, upper case."""
    return F.upper(collapse(F.translate(line, "–—", "--")))


def form_fold(text: Column) -> Column:
    """Collapsed, upper case, no space around slashes."""
    return F.regexp_replace(F.upper(collapse(text)), f"(?U)[{WS}]*/[{WS}]*", "/")


def chunk_key(text: Column, compose: bool = True) -> Column:
    """Content key of a chunk: equal texts, equal keys."""
    return F.concat(F.lit("CHK-"), F.substring(F.sha2(normalize(text, compose), 256), 1, 12))


def requirement_id(file_id: Column, verbatim: Column, occurrence: Column, atomic_ord: Column, compose: bool = True) -> Column:
    key = F.concat_ws("|", file_id, normalize(verbatim, compose), occurrence.cast("string"), atomic_ord.cast("string"))
    return F.concat(F.lit("REQ-"), F.substring(F.sha2(key, 256), 1, 10))


def golden_id(verbatim: Column, atomic: Column) -> Column:
    return F.concat(F.lit("GOLD-"), F.substring(F.sha2(F.concat_ws("|", verbatim, atomic), 256), 1, 10))


def display_label(section_label: Column, ordinal: Column) -> Column:
    return F.concat_ws("-", section_label, ordinal.cast("string"))


def file_stem_id(stem: Column) -> Column:
    """A file's stem in lower case, other characters as single dashes, at most 40 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def truncate(text: Column, limit: int = 120) -> Column:
    """Collapsed, and cut with an ellipsis beyond the limit."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def sanitize(text: str) -> str:
    """Lone surrogates become replacement characters; other text is returned as it is."""
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text
