"""DuckDB SQL for the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS, SYMBOLS

_SPACE_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_FOLDED_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_FOLDED_WORDS.format("text")} AS ws FROM documents),
b AS (SELECT item_id, {_FOLDED_WORDS.format("text")} AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM bw),
sizes AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
dk AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k FROM dw),
hits AS (SELECT doc_id, dk.n, i, item_id FROM dk JOIN bk ON dk.k = bk.k AND dk.n = bk.n),
spots AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS.format("text")} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _verdict() -> str:
    tests = []
    for r in RULES:
        ratio = f"(CAST({r.over} AS DOUBLE) / nullif({r.under}, 0))"
        tests += [f"coalesce({ratio} {op} {x}, false)" for op, x in ((">=", r.least), ("<=", r.most)) if x is not None]
    return " AND ".join(tests)


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACE_WORDS.format("text")} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
again AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM g JOIN again USING (doc_id, k)) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  CAST(len(list_filter(ws, lambda x: regexp_full_match(x, '(?:{"|".join(dict.fromkeys(STOP_WORDS))})[.,;:]?'))) AS BIGINT) AS n_stop_words,
  CAST(len(ls) AS BIGINT) AS n_lines
  FROM d LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_verdict()} AS kept FROM v
"""
