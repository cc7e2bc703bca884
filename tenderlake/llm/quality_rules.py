"""Rule-based quality filter: a threshold table compiled into one projection of built-in functions.

Every measure is a Spark expression over one row, so the operator is a single
narrow projection: no shuffle, no Python, and its cost follows the text.

Defined results: null text counts as empty (no words: it fails the base rule);
very long texts are measured whole; equal rows give equal rows; empty tables give
empty tables. Columns of the input are kept, and measures carry the given prefix,
so clashing names in the input are only those that the caller asks for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "the of and to in is that it for on with as was at by be this are from or an not have "
    "le la les de des du et un une en que qui est dans pour par sur au plus ne pas "
    "der die das und ein eine zu den von mit dem sich auf für ist im nicht als auch es an "
    "el los las y un una que en se del por con para su al lo no más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: a ratio of two measures and its allowed range."""

    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None


#: The threshold table. A document is kept if every ratio lies in its range.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_share", "n_dup_lines", "n_lines", None, 0.5),
)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array, the first included.

    Windows are hashed, sorted with their positions and compared with their sorted
    neighbours; the covered words are the union of the repeated windows' spans.
    """

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, j: F.coalesce(x["h"] == F.get(pairs, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, j + 1)["h"], F.lit(False)))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")), lambda acc: acc["n"])

    def windows(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(bound(F.sort_array(grams), covered))

    return bound(words, windows).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Every measure that rules may name, as expressions of the text."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stop = "|".join(dict.fromkeys(STOP_WORDS))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.regexp_count(text, F.lit(rf"(?<![^\x20\x09-\x0D])(?:{stop})[.,;:]?(?![^\x20\x09-\x0D])")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def verdict(prefix: str = "", rules: Sequence[Rule] = RULES) -> Column:
    """True where every ratio of the table lies in its range; a ratio over nothing is out of range."""
    passed = F.lit(True)
    for rule in rules:
        ratio = F.try_divide(F.col(prefix + rule.over).cast("double"), F.col(prefix + rule.under))
        for limit, holds in ((rule.least, lambda r, x: r >= x), (rule.most, lambda r, x: r <= x)):
            if limit is not None:
                passed = passed & F.coalesce(holds(ratio, F.lit(limit)), F.lit(False))
    return passed


def apply_rules(docs: DataFrame, text: str = "text", prefix: str = "", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with its measures, base_failed and kept; an input column of such a name is replaced, unless a prefix tells them apart."""
    found = docs.withColumns({prefix + k: v for k, v in measures(F.col(text)).items()})
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    failed = (n < 50) | (100 * again > 50 * n)
    return found.withColumns({f"{prefix}base_failed": failed, f"{prefix}kept": ~failed & verdict(prefix, rules)})
