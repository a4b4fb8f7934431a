"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

import re

from brightloom.llm.licenses import PERCENT, SHINGLE, TEMPLATES, size_class, template_shingles
from brightloom.llm.quality import STOP_WORDS
from brightloom.llm.secrets import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w, coalesce(text, '') AS body,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(regexp_replace(x, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'))
             IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))::BIGINT AS n_ellipsis_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words
  FROM d LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT *, concat_ws(',',
    CASE WHEN n_words < 50 THEN 'too_short' END,
    CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_windows' END,
    CASE WHEN n_words > 1000000 THEN 'too_long' END,
    CASE WHEN word_chars < 2 * n_words THEN 'short_words' END,
    CASE WHEN word_chars > 12 * n_words THEN 'long_words' END,
    CASE WHEN 100 * n_symbols > 20 * n_words THEN 'symbols' END,
    CASE WHEN n_stop_words < 2 THEN 'stop_words' END,
    CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 'repeated_lines' END,
    CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullets' END,
    CASE WHEN 100 * n_ellipsis_lines > 50 * n_lines THEN 'ellipses' END,
    CASE WHEN 100 * n_letter_words < 60 * n_words THEN 'no_letters' END) AS broken_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       broken_rules = '' AS kept, broken_rules
FROM r
"""



def _either_case(pattern: str) -> str:
    """RE2 folds letters beyond ASCII under (?i:), so each letter becomes a class."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)


def _op9() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = _either_case(r.pattern).replace("((", "(", 1).replace("))", ")", 1).replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {r.least} AS least, "
            f"regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS v, "
            f"string_split_regex(t, '{pattern}') AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
        )
    return f"""
WITH hits AS ({" UNION ALL ".join(parts)}), each_hit AS (
  SELECT doc_id, o, kind, least, m[i] AS m, v[i] AS v,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)
), kept AS (
  SELECT doc_id, o, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM each_hit WHERE length(v) >= least
), g AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


def _op7() -> str:
    rows = [(name, size_class(len(g)), len(g), x) for name, g in template_shingles(TEMPLATES).items() for x in g]
    values = ", ".join(f"('{a}', {b}, {c}, '{x}')" for a, b, c, x in rows)
    return rf"""
WITH t(license, cls, n_template, gram) AS (VALUES {values}), d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents
), g AS (
  SELECT doc_id, i - 1 AS i, list_aggregate(w[i:i + {SHINGLE - 1}], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d WHERE len(w) >= {SHINGLE})
), hit AS (
  SELECT doc_id, license, cls, n_template, gram, unnest([i // cls - 1, i // cls]) AS nth FROM g JOIN t USING (gram)
), win AS (
  SELECT doc_id, license, cls, n_template, nth, count(DISTINCT gram) AS n FROM hit WHERE nth >= 0
  GROUP BY ALL HAVING count(DISTINCT gram) * 100 >= n_template * {PERCENT}
)
SELECT doc_id, license, max(n)::BIGINT AS n_matched, n_template::BIGINT AS n_template,
       (arg_max(nth, n * 1000000 - nth) * cls)::BIGINT AS first_word, count(*) AS n_windows
FROM win GROUP BY doc_id, license, n_template, cls
"""


#: Runs of lines by their whole text, from each line on and up to each line until they have 50 words.
OP3 = r"""
WITH l AS (
  SELECT doc_id, i, x, sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS c,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text <> '')
), r AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= 50 GROUP BY b.doc_id, b.i
), t AS (
  SELECT doc_id, s, e, array_to_string(string_split(text, chr(10))[s:e], chr(10)) AS run FROM r JOIN documents USING (doc_id)
), late AS (
  SELECT doc_id, s, e FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM late
), kept AS (
  SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_deleted
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN n_lines IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1, "op3_linededup": OP3, "op7_licenses": _op7(), "op9_secrets": _op9()}
