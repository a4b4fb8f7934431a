"""DuckDB SQL for the queries of ``more``."""

from __future__ import annotations

from typing import Any

from brightloom.operators import domains
from brightloom.plans.sql import _PAIRS, BIOES, EV, GRAMS, HASH, PP, SP, SPLIT


def _values(rows: list[tuple]) -> str:
    def one(v: Any) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _slots() -> str:
    out = []
    for d, spec in domains.DOMAINS.items():
        for i, s in enumerate(spec["slots"]):
            c = s["constraint"]
            out.append((d, s["name"], i, s["value_type"], "|".join(c.get("choices", [])), c.get("minimum", c.get("min_length")), c.get("maximum", c.get("max_length"))))
    return f"SELECT d AS domain, s AS slot, i::BIGINT AS position, t AS value_type, c AS choices, lo::DOUBLE AS low, hi::DOUBLE AS high FROM (VALUES {_values(out)}) v(d, s, i, t, c, lo, hi)"


def _intents() -> str:
    rows = [(d, i["name"], ",".join(s for s, _ in i["slots"]), ",".join(s for s, o in i["slots"] if not o)) for d, spec in domains.DOMAINS.items() for i in spec["intents"]]
    return f"SELECT * FROM (VALUES {_values(rows)}) v(domain, intent, slots, required)"


def _templates() -> str:
    rows = [(d, g, p, words) for (d, g), items in domains.TEMPLATES.items() for p, words in items]
    return (
        "SELECT domain, language, pattern_id, split_part(pattern_id, '/', 2) AS intent, (length(words) - length(replace(words, ' ', '')) + 1)::BIGINT AS n_tokens, "
        f"(length(words) - length(replace(words, '{{', '')))::BIGINT AS n_slots FROM (VALUES {_values(rows)}) v(domain, language, pattern_id, words)"
    )


def _lexicon() -> str:
    rows = [(d, g, s, surface, str(v)) for (d, g), lexicon in domains.LEXICONS.items() for s, entries in lexicon.items() for surface, v in entries.items()]
    return f"(VALUES {_values(rows)}) v(domain, language, slot, surface, value)"


VALUES = """
WITH v AS (
  SELECT p_partkey, 'music-control' AS domain, 'genre' AS slot, ['pop', 'folk', 'jazz', 'rock'][p_partkey % 4 + 1] AS value, p_partkey % 4 <> 1 AS value_ok FROM part
  UNION ALL SELECT p_partkey, 'music-control', 'volume-level', (p_size * 3)::VARCHAR, p_size * 3 <= 100 FROM part
  UNION ALL SELECT p_partkey, 'music-control', 'song', p_name, length(p_name) BETWEEN 1 AND 64 FROM part
  UNION ALL SELECT p_partkey, 'calendar', 'start-time', lpad((p_size % 30)::VARCHAR, 2, '0') || ':30', p_size % 30 < 24 FROM part
  UNION ALL SELECT p_partkey, 'calendar', 'participant', p_type || p_name, length(p_type || p_name) BETWEEN 1 AND 32 FROM part
  UNION ALL SELECT p_partkey, 'weather', 'song', p_name, false FROM part
) SELECT * FROM v
"""

ANNOTATIONS = f"""
WITH {EV}, a AS (
  SELECT user_id, day, arg_min(event_type, i) AS k, bool_or(g LIKE '%-x') AS x, bool_or(g LIKE '%-y') AS y FROM ev GROUP BY user_id, day
)
SELECT user_id, day, CASE k WHEN 'view' THEN 'query-forecast' WHEN 'signup' THEN 'weather-alert' WHEN 'purchase' THEN 'set-volume' ELSE 'query-weather' END AS intent,
       CASE WHEN k = 'purchase' THEN 'unknown-intent' WHEN k = 'signup' AND y THEN 'undeclared-slot' WHEN k IN ('click', 'error') AND NOT x THEN 'missing-slot'
            WHEN k = 'view' AND NOT y THEN 'missing-slot' ELSE 'none' END AS problem
FROM a
"""

#: Overlapping pairs of a day, best first; each takes its two spans if both are free.
PARTIAL = f"""
WITH RECURSIVE {EV}, {SP}, {PP}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s) AS gi FROM gs), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s) AS pi FROM ps),
met AS (
  SELECT a.user_id, a.day, gi, pi, (least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / (greatest(a.e, b.e) - least(a.s, b.s)) AS share
  FROM a JOIN b ON a.user_id = b.user_id AND a.day = b.day AND a.label = b.label AND least(a.e, b.e) > greatest(a.s, b.s)
), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY share DESC, gi, pi) AS n FROM met),
walk AS (
  SELECT user_id, day, 0::BIGINT AS n, []::BIGINT[] AS ug, []::BIGINT[] AS up, 0::DOUBLE AS c FROM (SELECT DISTINCT user_id, day FROM k)
  UNION ALL
  SELECT w.user_id, w.day, k.n, CASE WHEN list_contains(ug, gi) OR list_contains(up, pi) THEN ug ELSE list_append(ug, gi) END,
         CASE WHEN list_contains(ug, gi) OR list_contains(up, pi) THEN up ELSE list_append(up, pi) END, CASE WHEN list_contains(ug, gi) OR list_contains(up, pi) THEN c ELSE c + share END
  FROM walk w JOIN k ON k.user_id = w.user_id AND k.day = w.day AND k.n = w.n + 1
), last AS (SELECT user_id, day, arg_max(c, n) AS c FROM walk GROUP BY user_id, day),
t AS (SELECT (SELECT count(*) FROM gs) AS gold, (SELECT count(*) FROM ps) AS pred, (SELECT sum(c) FROM last) AS credit),
r AS (SELECT *, credit / pred AS p, credit / gold AS q FROM t)
SELECT gold, pred, round(credit, 9) AS credit, round(p, 9) AS precision, round(q, 9) AS recall, round(2 * p * q / (p + q), 9) AS f1 FROM r
"""

_WEIGHT = " + ".join(f"(u >= {c})::INT" for c in (385749, 771499, 964373, 1028665, 1044738, 1047952, 1048488, 1048565))
BOOTSTRAP = f"""
WITH r AS (SELECT doc_id, CASE WHEN quality = toxic THEN 1 ELSE 0 END AS ok FROM labels),
h AS (SELECT ok, b, sha256('0|' || doc_id || '|' || b) AS h FROM r, range(17) t(b)),
u AS (SELECT ok, b * 12 + j AS n, ('0x' || substr(h, j * 5 + 1, 5))::BIGINT AS u FROM h, range(12) t(j) WHERE b * 12 + j < 200),
w AS (SELECT ok, n, {_WEIGHT} AS w FROM u),
v AS (SELECT n, sum(ok * w) / sum(w) AS v FROM w GROUP BY n)
SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, count(*) AS replicates FROM v
"""

GENERATED = """
WITH k AS (SELECT k, ('0x' || substr(sha256('["split",1234,"' || k || '"]'), 9, 8))::BIGINT AS h FROM range(4) t(k)),
o AS (SELECT k, (row_number() OVER (ORDER BY h, k::VARCHAR) - 1) % 3 AS s FROM k),
p AS (SELECT k, s, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS at, count(*) OVER (PARTITION BY s) AS m FROM o),
rows AS (SELECT 'train' AS split, 0 AS s, i FROM range(64) t(i) UNION ALL SELECT 'dev', 1, i FROM range(16) t(i) UNION ALL SELECT 'test', 2, i FROM range(16) t(i))
SELECT split, ['weather/query-weather/0', 'weather/query-weather/1', 'weather/query-forecast/0', 'weather/weather-alert/0'][i % 4 + 1] AS pattern_id, k AS speaker_id,
       CASE i % 2 WHEN 0 THEN 30.0 ELSE 15.0 END::DOUBLE AS snr_db, count(*) AS n
FROM rows JOIN p ON p.s = rows.s AND p.at = i % m GROUP BY ALL
"""

_FRAMES = "fr AS (SELECT vec_id, f, embedding[f * 8 + 1 : f * 8 + 16]::DOUBLE[] AS x FROM embeddings, range(0, 1000) t(f) WHERE f * 8 + 16 <= len(embedding))"
_POWER = f"""
{_FRAMES}, sm AS (SELECT vec_id, f, n, x[n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS v FROM fr, range(16) t(n)),
pw AS (SELECT vec_id, f, b, power(sum(v * cos(2 * pi() * b * n / 16)), 2) + power(sum(v * sin(2 * pi() * b * n / 16)), 2) AS p FROM sm, range(9) t(b) GROUP BY ALL)"""
_BANK = """
ed AS (SELECT i, 700 * (power(10, (2595 * log10(1 + 20.0 / 700) + i * (2595 * log10(1 + 480.0 / 700) - 2595 * log10(1 + 20.0 / 700)) / 5) / 2595) - 1) AS hz FROM range(6) t(i)),
tr AS (SELECT l.i AS m, b, greatest(0, least((b * 62.5 - l.hz) / (c.hz - l.hz), (r.hz - b * 62.5) / (r.hz - c.hz))) AS w
       FROM ed l JOIN ed c ON c.i = l.i + 1 JOIN ed r ON r.i = l.i + 2, range(9) t(b)),
bk AS (SELECT m, b, w / max(w) OVER (PARTITION BY m) AS w FROM tr)"""

LOG_MEL = f"""
WITH {_POWER}, {_BANK}, ml AS (SELECT vec_id, f, m, ln(greatest(sum(p * w), 1e-10))::FLOAT::DOUBLE AS v FROM pw JOIN bk ON bk.b = pw.b GROUP BY vec_id, f, m)
SELECT vec_id, count(DISTINCT f) AS n_frames, round(avg(v), 5) AS mean_log_mel FROM ml GROUP BY vec_id
"""


def oracle_sql() -> dict[str, str]:
    lexicon = _lexicon()
    slot = f"""('0x' || substr(sha256('["slot-band","city"]'), 1, 8))::BIGINT % 8"""
    value = """sha256('["value","weather","city","' || n_name || '"]')"""
    first = f"(400.0 + {slot} * 120.0 + ('0x' || substr({value}, 1, 4))::BIGINT % 60)"
    return {
        "domain_slots": _slots(),
        "domain_intents": _intents(),
        "template_tokens": _templates(),
        "lexicon_values": f"SELECT *, true AS value_ok FROM {lexicon}",
        "value_check": VALUES,
        "annotation_check": ANNOTATIONS,
        "cjk_characters": f"SELECT DISTINCT c AS character, regexp_full_match(c, '[一-鿿㐀-䶿　-〿＀-￯]') AS cjk FROM (SELECT unnest(string_split(surface, '')) AS c FROM {lexicon})",
        "confusion_totals": f"WITH p AS ({_PAIRS}) SELECT count(*)::BIGINT AS total, count(*) FILTER (gold = pred)::BIGINT AS correct, round(count(*) FILTER (gold = pred) / count(*), 9) AS accuracy FROM p",
        "sample_text": "WITH t AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS t FROM conversations GROUP BY 1) SELECT conv_id, length(t)::BIGINT AS n_chars, sha256(t) AS sha256 FROM t",
        "exact_groups": f"WITH h AS (SELECT doc_id, {HASH} AS text_hash FROM documents) SELECT text_hash, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM h GROUP BY 1 HAVING count(*) > 1",
        "feature_vector": f"SELECT t.id, coalesce(k, 0)::BIGINT AS n_buckets, coalesce(a, 0.0) AS largest, coalesce(b, 0.0) AS total FROM (SELECT conv_id * 1000 + turn AS id FROM conversations) t LEFT JOIN (SELECT id, count(*) AS k, round(max(n) / sqrt(sum(n * n)), 9) AS a, round(sum(n) / sqrt(sum(n * n)), 9) AS b FROM ({GRAMS}) GROUP BY id) g ON g.id = t.id",
        "spans_of_bioes": f"WITH {EV}, {SP} SELECT user_id, day, label, (e - s)::BIGINT AS n_tokens, s AS start_pos FROM gs",
        "spans_to_bioes": BIOES,
        "tags_problem": f"WITH {EV} SELECT user_id, day, coalesce(min(i) FILTER (g LIKE 'I-%' AND NOT (gb <> 'O' AND substr(gb, 3) = substr(g, 3))), -1)::BIGINT AS first_bad FROM lg GROUP BY user_id, day",
        "split_values": f"WITH {SPLIT} SELECT DISTINCT split, c_nationkey::BIGINT AS value FROM customer JOIN sp USING (c_custkey)",
        "row_digest": """SELECT n_nationkey::BIGINT AS key, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""",
        "speaker_shifts": """SELECT c_custkey, round(1.0::DOUBLE + 0.12::DOUBLE * (2.0::DOUBLE * (('0x' || substr(sha256('["speaker-shift",' || c_custkey || ']'), 1, 8))::BIGINT / 4294967295.0::DOUBLE) - 1.0::DOUBLE), 6) AS shift FROM customer""",
        "token_sounds": f"""SELECT n_nationkey, round(150.0::DOUBLE + (('0x' || substr(sha256('["filler","weather","' || n_name || '"]'), 1, 8))::BIGINT % 1000000) / 1000000.0::DOUBLE * 250.0::DOUBLE, 6) AS filler, round({first}::DOUBLE, 6) AS first, round({first}::DOUBLE * (2.2::DOUBLE + (('0x' || substr({value}, 5, 4))::BIGINT % 100) / 100.0::DOUBLE * 0.6::DOUBLE), 6) AS second FROM nation""",
        "generated_counts": GENERATED,
        "generated_layout": "SELECT 'train-' || lpad(i::VARCHAR, 5, '0') AS utterance_id, true AS layout_ok, true AS intent_ok FROM range(30) t(i) UNION ALL SELECT 'dev-' || lpad(i::VARCHAR, 5, '0'), true, true FROM range(10) t(i)",
        "pcm_back": "SELECT vec_id, (i - 1)::BIGINT AS pos, round((trunc(greatest(-1, least(1, embedding[i]::DOUBLE)) * 32767) / 32767.0::DOUBLE)::FLOAT::DOUBLE, 7) AS sample FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
        "frame_signal": f"WITH {_FRAMES} SELECT vec_id, f AS frame, round(x[1], 7) AS first, round(x[16], 7) AS last, len(x)::BIGINT AS n FROM fr",
        "stft_power": f"WITH {_POWER} SELECT vec_id, f AS frame, b AS bin, round(p, 6) AS power FROM pw",
        "mel_filterbank": f"WITH {_BANK} SELECT m AS mel, b AS bin, round(w, 9) AS weight FROM bk",
        "fixture_misses": "SELECT l.doc_id IS NULL AS missing, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1",
        "span_f1_partial": PARTIAL,
        "bootstrap_ci": BOOTSTRAP,
        "log_mel": LOG_MEL,
    }
