"""DuckDB statements for the queries that SQL can express."""
from __future__ import annotations

import re

from .secret_scan import BASE, RULES, Rule
from .tables import LOWER, UPPER

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _pattern(rule: Rule) -> str:
    """A rule's regex for RE2, whose (?i) also folds letters beyond ASCII and whose \\s lacks \\x0B."""
    either = lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1])
    return re.sub(r"\(\?i:(\([^)]*\))\)", either, rule.regex).replace("\\s", r"\x20\x09-\x0D").replace("'", "''")


def _matches(place: int, rule: Rule) -> str:
    """(rid, place, kind, i, gap, m, g): a rule's matches, the text before each since the last, the counted group."""
    p = _pattern(rule)
    return f"""SELECT rid, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, unnest(range(1, len(m) + 1)) AS i, unnest(gaps[:len(m)]) AS gap, unnest(m) AS m, unnest(g) AS g
  FROM (SELECT rid, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.counted}) AS g FROM d) WHERE len(m) > 0"""


_ALL_MATCHES = "\n  UNION ALL ".join(_matches(k, r) for k, r in enumerate(RULES))
_BASE = ", ".join(f"'{r.kind}'" for r in BASE)
_SPAN_ORDER = "',' ORDER BY start, place, size"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOW}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_secret_scan": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_ALL_MATCHES}),
p AS (SELECT rid, place, kind, length(m) AS size, length(g) >= least AS long_enough,
  sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS start FROM m WINDOW w AS (PARTITION BY rid, place ORDER BY i)),
s AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || start || ':' || (start + size), {_SPAN_ORDER}) FILTER (WHERE kind IN ({_BASE})) AS base, string_agg(kind || ':' || start || ':' || (start + size), {_SPAN_ORDER}) AS spans
  FROM p WHERE long_enough GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)""",
    "op10_decontaminate": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, dg.i, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
