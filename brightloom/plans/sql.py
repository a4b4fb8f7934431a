"""DuckDB SQL for the engine's queries: relational forms, written apart from the Spark ones."""

from __future__ import annotations

from brightloom.operators.corpus import ANSWERS

#: One row per tag: e (raw), r (promoted gold), q (promoted prediction), position i in (user_id, day).
EV = """
ev AS (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS i,
         CASE event_type WHEN 'click' THEN 'O' WHEN 'view' THEN 'B-x' WHEN 'signup' THEN 'I-x' WHEN 'purchase' THEN 'B-y' ELSE 'I-y' END AS g
  FROM events
), pv AS (
  SELECT *, CASE WHEN event_id % 7 = 0 THEN 'O' WHEN event_id % 11 = 0 THEN 'B-x' ELSE g END AS p FROM ev
), lg AS (
  SELECT *, coalesce(lag(g) OVER w, 'O') AS gb, coalesce(lag(p) OVER w, 'O') AS pb FROM pv
  WINDOW w AS (PARTITION BY user_id, day ORDER BY i)
), pro AS (
  SELECT *, CASE WHEN g LIKE 'I-%' AND NOT (gb <> 'O' AND substr(gb, 3) = substr(g, 3)) THEN 'B-' || substr(g, 3) ELSE g END AS r,
         CASE WHEN p LIKE 'I-%' AND NOT (pb <> 'O' AND substr(pb, 3) = substr(p, 3)) THEN 'B-' || substr(p, 3) ELSE p END AS q
  FROM lg
)"""


def _spans(column: str, name: str) -> str:
    """Gaps and islands: a span is a B and the I's that follow it."""
    return f"""
{name}_n AS (
  SELECT user_id, day, i, {column} AS t, sum(CASE WHEN {column} LIKE 'B-%' OR {column} = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY i) AS k FROM pro
), {name} AS (
  SELECT user_id, day, substr(min(t) FILTER (t LIKE 'B-%'), 3) AS label, min(i) AS s, max(i) + 1 AS e
  FROM {name}_n WHERE t <> 'O' GROUP BY user_id, day, k
)"""


SP = _spans("r", "gs")
PP = _spans("q", "ps")

SCORES = f"""
WITH {EV}, {SP}, {PP}, gn AS (SELECT count(*) AS gold FROM gs), pn AS (SELECT count(*) AS pred FROM ps),
cn AS (SELECT count(*)::DOUBLE AS credit FROM gs JOIN ps USING (user_id, day, label, s, e)),
pr AS (SELECT gold, pred, credit, CASE WHEN pred = 0 THEN 1.0 ELSE credit / pred END AS p, CASE WHEN gold = 0 THEN 1.0 ELSE credit / gold END AS r FROM gn, pn, cn)
SELECT gold, pred, credit, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM pr
"""

TURNS = """
it AS (
  SELECT user_id, day, arg_min(event_type, i) AS gi, CASE WHEN arg_min(event_id, i) % 5 = 0 THEN 'click' ELSE arg_min(event_type, i) END AS pi
  FROM ev GROUP BY user_id, day
)"""

JOINED = """
(SELECT user_id, day, string_agg({0}, ' ' ORDER BY i) AS tags FROM {1} GROUP BY user_id, day)
"""

DROP = f"""
WITH RECURSIVE {EV}, walk AS (
  SELECT user_id, day, i, CASE WHEN g LIKE 'I-%' THEN 'O' ELSE g END AS t FROM ev WHERE i = 0
  UNION ALL
  SELECT v.user_id, v.day, v.i, CASE WHEN v.g LIKE 'I-%' AND (w.t = 'O' OR substr(w.t, 3) <> substr(v.g, 3)) THEN 'O' ELSE v.g END
  FROM walk w JOIN ev v ON v.user_id = w.user_id AND v.day = w.day AND v.i = w.i + 1
)
SELECT user_id, day, string_agg(t, ' ' ORDER BY i) AS tags FROM walk GROUP BY user_id, day
"""

VALID = f"""
WITH {EV} SELECT user_id, day, bool_and(NOT (g LIKE 'I-%' AND NOT (gb <> 'O' AND substr(gb, 3) = substr(g, 3)))) AS valid FROM lg GROUP BY user_id, day
"""

BIOES = f"""
WITH {EV}, nx AS (SELECT *, coalesce(lead(r) OVER (PARTITION BY user_id, day ORDER BY i), 'O') AS n FROM pro)
SELECT user_id, day, string_agg(CASE WHEN r = 'O' THEN r WHEN n LIKE 'I-%' THEN r WHEN r LIKE 'B-%' THEN 'S' || substr(r, 2) ELSE 'E' || substr(r, 2) END, ' ' ORDER BY i) AS tags
FROM nx GROUP BY user_id, day
"""

_PAIRS = "SELECT event_type AS gold, CASE WHEN event_id % 5 = 0 THEN 'click' WHEN event_id % 13 = 0 THEN 'error' ELSE event_type END AS pred FROM events"

CONFUSION = f"""
WITH p AS ({_PAIRS}), l AS (SELECT DISTINCT gold AS x FROM p UNION SELECT DISTINCT pred FROM p), c AS (SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL)
SELECT a.x AS gold, b.x AS pred, coalesce(n, 0)::BIGINT AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.gold = a.x AND c.pred = b.x
"""

PER_LABEL = f"""
WITH p AS ({_PAIRS}), l AS (SELECT DISTINCT gold AS x FROM p UNION SELECT DISTINCT pred FROM p),
c AS (SELECT x, count(*) FILTER (gold = x) AS g, count(*) FILTER (pred = x) AS q, count(*) FILTER (gold = x AND pred = x) AS h FROM l, p GROUP BY x),
r AS (SELECT x, g, CASE WHEN q = 0 THEN 0 ELSE h / q END AS p, CASE WHEN g = 0 THEN 0 ELSE h / g END AS r FROM c)
SELECT x AS label, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1, g::BIGINT AS support FROM r
"""

SLICES = f"""
WITH {EV}, {SP}, {PP}, {TURNS},
gc AS (SELECT user_id, day, count(*) AS g FROM gs GROUP BY ALL), pc AS (SELECT user_id, day, count(*) AS p FROM ps GROUP BY ALL),
cc AS (SELECT user_id, day, count(*) AS c FROM gs JOIN ps USING (user_id, day, label, s, e) GROUP BY ALL),
a AS (SELECT user_id, day, CASE WHEN gi = pi THEN 1 ELSE 0 END AS ok, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(c, 0) AS c
      FROM it LEFT JOIN gc USING (user_id, day) LEFT JOIN pc USING (user_id, day) LEFT JOIN cc USING (user_id, day)),
u AS (SELECT 'day' AS kind, strftime(day, '%Y-%m-%d') AS value, * FROM a UNION ALL SELECT 'user', 'u' || (user_id % 10), * FROM a),
s AS (SELECT kind, value, count(*) AS records, sum(ok) / count(*) AS ia, CASE WHEN sum(p) = 0 THEN 1.0 ELSE sum(c) / sum(p) END AS pr,
      CASE WHEN sum(g) = 0 THEN 1.0 ELSE sum(c) / sum(g) END AS re FROM u GROUP BY kind, value)
SELECT kind, value, records, round(ia, 9) AS intent_accuracy, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS slot_strict FROM s
"""

TURN_ACC = f"""
WITH {EV}, {SP}, {PP}, {TURNS},
a AS (SELECT user_id, day, string_agg(label || s || ':' || e, ' ' ORDER BY s) AS x FROM gs GROUP BY ALL),
b AS (SELECT user_id, day, string_agg(label || s || ':' || e, ' ' ORDER BY s) AS y FROM ps GROUP BY ALL),
t AS (SELECT sum(CASE WHEN gi = pi AND coalesce(x, '') = coalesce(y, '') THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total
      FROM it LEFT JOIN a USING (user_id, day) LEFT JOIN b USING (user_id, day))
SELECT correct, total, round(correct / total, 9) AS accuracy FROM t
"""

INTENT_ACC = f"""
WITH {EV}, {TURNS}, t AS (SELECT sum(CASE WHEN gi = pi THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total FROM it)
SELECT correct, total, round(correct / total, 9) AS accuracy FROM t
"""

NORMAL = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[\p{P}\p{Z}\p{C}\s]', '', 'g')"
HASH = f"""sha256('{{"normalized_text":"' || {NORMAL} || '"}}')"""

GRAMS = f"""
WITH n AS (SELECT conv_id * 1000 + turn AS id, {NORMAL} AS t FROM conversations),
g AS (SELECT id, substr(t, i, 3) AS g FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM n WHERE t <> ''))
SELECT id, ('0x' || substr(sha256('"' || g || '"'), 7, 2))::INT AS bucket, count(*) AS n FROM g GROUP BY ALL
"""

TURN_RULES = r"""
WITH w AS (
  SELECT *, row_number() OVER o AS n, lag(role) OVER o AS b, lead(role) OVER o AS a FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, count(*) AS n_turns, bool_and(coalesce(trim(text, ' ') <> '', false) AND CASE role
  WHEN 'system' THEN n = 1 AND a IS NOT NULL WHEN 'user' THEN coalesce(b, 'system') IN ('system', 'assistant') AND a IS NOT NULL
  WHEN 'assistant' THEN coalesce(b = 'user', false) ELSE false END) AS valid
FROM w GROUP BY conv_id
"""

FLAGS = """
SELECT conv_id, turn, length(text) * 10.0 BETWEEN 200 AND 30000 AS duration_ok,
       CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 5.0 >= 10 END AS snr_ok, starts_with(text, 'The') AS answer_canonical,
       concat_ws(',', CASE WHEN NOT length(text) * 10.0 BETWEEN 200 AND 30000 THEN 'duration-out-of-bounds' END,
                 CASE WHEN turn % 3 <> 0 AND turn * 5.0 < 10 THEN 'snr-below-minimum' END,
                 CASE WHEN NOT starts_with(text, 'The') THEN 'answer-not-canonical' END) AS issues
FROM conversations WHERE role = 'assistant'
"""

SEGMENTS = """
seg AS (
  SELECT l_orderkey, l_linenumber, (l_quantity * 20)::BIGINT AS n, row_number() OVER w - 1 AS idx, sum((l_quantity * 20)::BIGINT + 320) OVER w AS e
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
), tot AS (SELECT l_orderkey, max(e) + 320 AS total FROM seg GROUP BY 1),
fr AS (SELECT l_orderkey, unnest(range(0, CASE WHEN total < 400 THEN 0 ELSE ((total - 400) // 160 + 1)::BIGINT END)) AS f FROM tot),
hit AS (
  SELECT fr.l_orderkey, f, coalesce(idx, -1)::BIGINT AS token FROM fr
  LEFT JOIN seg ON seg.l_orderkey = fr.l_orderkey AND f * 160 + 200 >= e - n AND f * 160 + 200 < e
)"""

SPLIT = """
ks AS (
  SELECT c_custkey, row_number() OVER (ORDER BY ('0x' || substr(sha256('["split",7,"' || c_custkey || '"]'), 9, 8))::BIGINT, c_custkey::VARCHAR) - 1 AS k
  FROM (SELECT DISTINCT c_custkey FROM customer)
), sp AS (SELECT c_custkey, CASE k % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM ks)"""

STREAM = """
WITH w AS (
  SELECT *, count(*) OVER o AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER o AS buy, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER o AS see
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (SELECT *, CASE WHEN buy >= see THEN 'purchase' ELSE 'view' END AS intent, greatest(buy, see) * 5 >= n AS stable FROM w),
st AS (SELECT user_id, intent, n, lag(intent) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s WHERE stable),
rv AS (SELECT user_id, count(*) FILTER (b <> intent) AS revisions, count(*) AS n_stable, min(n) AS first_stable FROM st GROUP BY user_id)
SELECT user_id, coalesce(revisions, 0)::BIGINT AS revisions, coalesce(n_stable, 0)::BIGINT AS n_stable, first_stable
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN rv USING (user_id)
"""

_WINDOW = "SELECT n, '{0}' AS name, round({1} - {2} * cos(2 * pi() * n / 400) + {3} * cos(4 * pi() * n / 400), 9) AS value FROM range(400) t(n)"


def oracle_sql() -> dict[str, str]:
    from brightloom.plans import more_sql

    return _oracle_sql() | more_sql.oracle_sql()


def _oracle_sql() -> dict[str, str]:
    joined = lambda column, name="pro": f"WITH {EV} SELECT * FROM {JOINED.format(column, name)}"
    answer = ANSWERS["en"].split("{intent}")[1].split("{slots}")[0]
    return {
        "tags_repair_promote": joined("r"),
        "tags_repair_drop": DROP,
        "tags_valid": VALID,
        "tags_to_spans": f"WITH {EV}, {SP} SELECT user_id, day, label, s AS start_pos, e AS end_pos FROM gs",
        "spans_to_tags": f"WITH {EV}, {SP}, x AS (SELECT pro.user_id, pro.day, i, CASE WHEN label IS NULL THEN 'O' WHEN i = s THEN 'B-' || label ELSE 'I-' || label END AS t FROM pro LEFT JOIN gs ON pro.user_id = gs.user_id AND pro.day = gs.day AND i >= s AND i < e) SELECT * FROM {JOINED.format('t', 'x')}",
        "bio_to_bioes": BIOES,
        "bioes_to_bio": joined("r"),
        "tag_slot_names": f"WITH {EV} SELECT user_id, day, coalesce(string_agg(DISTINCT substr(g, 3), ',' ORDER BY substr(g, 3)) FILTER (g <> 'O'), '') AS slots FROM ev GROUP BY ALL",
        "span_f1_strict": SCORES,
        "intent_accuracy": INTENT_ACC,
        "turn_accuracy": TURN_ACC,
        "slice_summary": SLICES,
        "confusion": CONFUSION,
        "confusion_per_label": PER_LABEL,
        "percentile": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem GROUP BY 1",
        "normalize_text": f"SELECT doc_id, {NORMAL} AS normalized FROM documents",
        "normalize_text_full": f"SELECT doc_id, {NORMAL} AS normalized FROM documents",
        "text_hash": f"SELECT doc_id, {HASH} AS text_hash FROM documents",
        "exact_duplicate_groups": f"WITH h AS (SELECT doc_id, {HASH} AS text_hash FROM documents), g AS (SELECT text_hash, min(doc_id) AS first_id, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, text_hash, first_id, n FROM h JOIN g USING (text_hash)",
        "gram_vector": GRAMS,
        "near_duplicate_pairs": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4",
        "turn_structure": TURN_RULES,
        "quality_flags": FLAGS,
        "quality_report": f"SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN issues = '' THEN 'ok' ELSE issues END, ',')) AS issue FROM ({FLAGS})) GROUP BY 1",
        "template_render": f"SELECT p_partkey, 'Intent: ' || p_brand || '{answer}' || p_type AS answer FROM part",
        "template_variables": "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all('{intent} of {brand}: ' || p_name || ' {intent}', '\\{([a-z][a-z0-9_]*)\\}', 1))), ',') AS variables FROM part",
        "slots_text": "SELECT n_nationkey, 'nation=' || n_name || '/' || lower(n_name) || ', region=' || r_name AS slots FROM nation JOIN region ON n_regionkey = r_regionkey",
        "tokenize_en": r"WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents) SELECT doc_id, nullif(len(w), 0)::BIGINT AS n_tokens, CASE WHEN len(w) > 0 THEN sha256(array_to_string(w, chr(10))) END AS tokens_sha256 FROM t",
        "tokenize_chars": r"WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^\s]') AS w FROM conversations) SELECT conv_id, turn, nullif(len(w), 0)::BIGINT AS n_tokens, CASE WHEN len(w) > 0 THEN sha256(array_to_string(w, chr(10))) END AS tokens_sha256 FROM t",
        "mixing_quotas": "WITH w AS (SELECT source, count(*)::DOUBLE AS w FROM documents GROUP BY 1), r AS (SELECT source, 137 * w / sum(w) OVER () AS raw FROM w), x AS (SELECT source, floor(raw) AS f, row_number() OVER (ORDER BY raw - floor(raw) DESC, source) AS rn, 137 - sum(floor(raw)) OVER () AS k FROM r) SELECT source, (f + CASE WHEN rn <= k THEN 1 ELSE 0 END)::BIGINT AS quota FROM x",
        "split_assign": f"WITH {SPLIT} SELECT c_custkey, split FROM sp",
        "derive_seed": """SELECT o_orderkey, ('0x' || substr(sha256('["example",7,"train",' || o_orderkey || ']'), 9, 8))::BIGINT AS seed FROM orders""",
        "leakage_check": f"WITH {SPLIT} SELECT split, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders JOIN sp ON o_custkey = c_custkey GROUP BY 1",
        "dataset_stats": "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 4) AS mean_chars, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1",
        "slot_mentions": f"WITH {EV} SELECT substr(r, 3) AS slot, count(*) AS n FROM pro WHERE r LIKE 'B-%' GROUP BY 1",
        "count_by": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
        "frame_token_map": f"WITH {SEGMENTS} SELECT l_orderkey, token, count(*) AS n_frames, min(f) AS first, max(f) AS last FROM hit GROUP BY 1, 2",
        "frame_span_tags": f"WITH {SEGMENTS}, sid AS (SELECT l_orderkey, idx, idx // 3 AS k FROM seg WHERE idx % 3 < 2) SELECT hit.l_orderkey, min(f) AS first, max(f) AS last FROM hit JOIN sid ON sid.l_orderkey = hit.l_orderkey AND sid.idx = token GROUP BY hit.l_orderkey, k",
        "frame_count": "SELECT o_orderkey, CASE WHEN n < 400 THEN 0 ELSE (n - 400) // 160 + 1 END AS n_frames FROM (SELECT o_orderkey, trunc(o_totalprice / 10)::BIGINT AS n FROM orders)",
        "window_values": " UNION ALL ".join(_WINDOW.format(*x) for x in (("hann", 0.5, 0.5, 0), ("hamming", 0.54, 0.46, 0), ("blackman", 0.42, 0.5, 0.08))),
        "mel_scale": "SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, round(p_retailprice, 6) AS hz FROM part",
        "pcm_roundtrip": "SELECT vec_id, (i - 1)::BIGINT AS pos, trunc(greatest(-1, least(1, embedding[i]::DOUBLE)) * 32767)::BIGINT AS pcm FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
        "cosine": "WITH h AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS cosine FROM embeddings JOIN h USING (label)",
        "json_validate": "SELECT event_id, json_type(props) = 'OBJECT' AS is_object, len(json_keys(props))::BIGINT AS n_keys, array_to_string(list_sort(json_keys(props)), ',') AS key_names FROM events",
        "check_value": "SELECT p_partkey, p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AS brand_ok, p_retailprice BETWEEN 950 AND 1500 AS price_ok, length(p_name) BETWEEN 1 AND 12 AS name_ok, p_size % 30 < 24 AS time_ok FROM part",
        "validate_ids": "SELECT p_partkey, regexp_full_match(replace(lower(p_type), ' ', '-'), '[a-z][a-z0-9]*(-[a-z0-9]+)*') AND length(p_type) <= 64 AS ok, regexp_full_match(p_type, '[a-z][a-z0-9]*(-[a-z0-9]+)*') AS raw_ok FROM part",
        "fixture_lookup": "SELECT o_orderkey, coalesce(c_mktsegment, 'missing') AS response FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
        "dataset_split_counts": f"WITH {SPLIT} SELECT s.split, count(sp.split) AS n FROM (VALUES ('train'), ('dev'), ('test'), ('none')) s(split) LEFT JOIN sp ON sp.split = s.split GROUP BY 1",
        "stream_frames": "SELECT event_id, p::BIGINT AS pushed, CASE WHEN p - 5120 < 400 THEN 0 ELSE (p::BIGINT - 5120 - 400) // 160 + 1 END AS committed FROM (SELECT event_id, sum(trunc(abs(value) * 100)::BIGINT + 160) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)",
        "stream_intent": STREAM,
        "stream_session": "SELECT user_id, count(*) AS chunks, p::BIGINT AS pushed, CASE WHEN p - 5120 < 400 THEN 0 ELSE (p - 5120 - 400) // 160 + 1 END::BIGINT AS committed, CASE WHEN p < 400 THEN 0 ELSE (p - 400) // 160 + 1 END::BIGINT AS final_frames FROM (SELECT user_id, sum(trunc(abs(value) * 100)::BIGINT + 160) OVER (PARTITION BY user_id)::BIGINT AS p FROM events) GROUP BY user_id, p",
        "flagship": f"WITH {EV}, {SP} SELECT label, count(*) AS n_spans, sum(e - s)::BIGINT AS n_tokens FROM gs GROUP BY 1",
    }
