"""DuckDB SQL of the catalogue's queries, written apart from the engine's expressions.

Shared common table expressions are text that several statements begin with.
"""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"
SEARCH_TERMS = ("the", "and", "tion", "of")

MESSAGES = """
chunks AS (
  SELECT (['claude-code', 'codex', 'cursor', 'copilot', 'copilot-cli', 'opencode', 'antigravity'])[conv_id % 7 + 1] AS tool, 'conv-' || conv_id AS sid,
    to_timestamp(1704067200 + conv_id * 3600 + turn * 60) AT TIME ZONE 'UTC' AS ts, role, text AS content, turn AS idx,
    CASE conv_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' END AS branch
  FROM conversations),
messages AS (
  SELECT sha256(tool || chr(0) || sid || chr(0) || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || chr(0) || role || chr(0) || idx || chr(0) || content || chr(0)) AS id,
    tool || ':' || sid AS ref, * FROM chunks WHERE length(trim(content)) > 0)"""
SESSIONS = (
    MESSAGES
    + """,
sessions AS (
  SELECT ref, any_value(tool) AS tool, first(branch ORDER BY ts, idx, id) FILTER (branch IS NOT NULL) AS branch, min(ts) AS t0, max(ts) AS t1, count(*) AS n,
    substr(first(content ORDER BY ts, idx, id), 1, 240) AS preview
  FROM messages GROUP BY ref)"""
)
SHOWN = f"ref AS session_ref, tool, branch AS git_branch, strftime(t0, {ISO}) AS started_at, strftime(t1, {ISO}) AS last_activity_at, n AS message_count, preview"


def units(size: int, stride: int, source: str = "messages", name: str = "") -> str:
    """Windows of ``source``; the start of each and whether an earlier one has reached the end."""
    return f""",
ordered{name} AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY ts, idx, id) - 1 AS p, count(*) OVER (PARTITION BY ref) AS c FROM {source}),
starts{name} AS (SELECT ref, c, unnest(range(0, c, {stride})) AS s FROM (SELECT DISTINCT ref, c FROM ordered{name})),
real{name} AS (SELECT * FROM starts{name} WHERE s = 0 OR s - {stride} + {size} < c),
units{name} AS (
  SELECT w.ref, any_value(tool) AS tool, first(idx ORDER BY p) AS i0, last(idx ORDER BY p) AS i1, min(ts) AS t0, max(ts) AS t1, string_agg(content, chr(10) ORDER BY p) AS body,
    'Session: ' || w.ref || chr(10) || 'Chronological window: messages ' || first(idx ORDER BY p) || ' through ' || last(idx ORDER BY p) || chr(10) ||
    string_agg('Turn ' || (p - s + 1) || '/' || least({size}, w.c - s) || ' | message_index=' || idx || ' | ' || role || ' @ ' || strftime(ts, {ISO}) || chr(10) || content, chr(10) ORDER BY p) AS content
  FROM real{name} w JOIN ordered{name} o ON o.ref = w.ref AND p >= s AND p < s + {size} GROUP BY w.ref, s, w.c),
unit{name} AS (
  SELECT *, sha256('retrieval-unit' || chr(0) || ref || chr(0) || i0 || chr(0) || i1 || chr(0) || sha256(content || chr(0)) || chr(0)) AS id FROM units{name})"""


ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def terms(x: str) -> str:
    return f"list_filter(string_split_regex(translate(lower({x}), '{ACCENTED}', '{FOLDED}'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"


INDEX = f""",
toks AS (SELECT id, {terms("body")} AS t FROM unit),
occ AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks),
whole AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks)"""


def bm25(hits: str) -> str:
    """Score of ``hits`` (id, phrase, tf)."""
    return f""",
hits AS ({hits}),
idf AS (SELECT phrase, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, n, avgdl FROM hits, whole GROUP BY phrase, n, avgdl),
scored AS (SELECT id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS bm25 FROM hits JOIN idf USING (phrase) JOIN toks USING (id) GROUP BY id)"""


WORDS = "SELECT id, term AS phrase, count(*) AS tf FROM occ WHERE term IN ('the', 'and', 'tion', 'of') GROUP BY id, term"
PAIRS = """SELECT a.id, 'of.the' AS phrase, count(*) AS tf FROM occ a JOIN occ b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.id
  UNION ALL SELECT id, 'in', count(*) FROM occ WHERE term = 'in' GROUP BY id"""


def grouped(rows: str, limit: int) -> str:
    """The walk in order of pos until the limit-th session appears; ``rows`` has ref, pos, score, relevance."""
    return f""",
first_pos AS (SELECT ref, min(pos) AS fp, row_number() OVER (ORDER BY min(pos)) AS met FROM {rows} GROUP BY ref),
cut AS (SELECT coalesce(max(fp) FILTER (met = {limit}), 1000000000) AS c FROM first_pos),
walked AS (
  SELECT r.*, fp, max(score) OVER (PARTITION BY r.ref) AS session_score, max(relevance) OVER (PARTITION BY r.ref) AS session_relevance, row_number() OVER (PARTITION BY r.ref ORDER BY pos) AS m
  FROM {rows} r JOIN first_pos USING (ref), cut WHERE met <= {limit} AND pos <= c),
found AS (SELECT *, dense_rank() OVER (ORDER BY session_score DESC, fp) AS session_rank FROM walked WHERE m <= 3)"""


VECTOR = """
v AS (
  SELECT lpad(vec_id::VARCHAR, 9, '0') AS id, vec_id, (['claude-code', 'codex', 'cursor', 'copilot', 'copilot-cli', 'opencode', 'antigravity'])[vec_id % 50 % 7 + 1] AS tool,
    to_timestamp(1704067200 + vec_id * 60) AS t, vec_id % 11 + 3 AS i1, label, embedding::DOUBLE[] AS e FROM embeddings),
q0 AS (SELECT e AS q FROM v WHERE vec_id = 0),
far AS (SELECT list_transform(range(64), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS q)"""


#: Ranks of a search for "label3 group2"; each unit has three terms, once each.
KEYWORDS = """,
term AS (SELECT id, t, unnest(['label' || label, 'group' || vec_id % 7]) AS term FROM v),
kwh AS (SELECT * FROM term WHERE term IN ('label3', 'group2')),
kwi AS (SELECT term, greatest(ln(((SELECT count(*) FROM v) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM kwh GROUP BY term),
kwr AS (
  SELECT id, 1.0 / row_number() OVER (ORDER BY score DESC, t DESC, id) AS k
  FROM (SELECT id, t, sum(idf) AS score FROM kwh JOIN kwi USING (term) GROUP BY id, t ORDER BY score DESC, t DESC, id LIMIT 15))"""


def semantic(query: str, limit: int, where: str = "true", keywords: bool = False) -> str:
    kw = "coalesce((SELECT k FROM kwr WHERE kwr.id = v.id), 0.0)" if keywords else "0.0"
    blend = "0.8 * sem + 0.2 * kw" if keywords else "sem"
    return f"""WITH {VECTOR}{KEYWORDS if keywords else ""},
c AS (SELECT v.*, tool || ':s' || (vec_id % 50) AS ref, list_cosine_similarity(e, q) AS cos, {kw} AS kw FROM v, {query}),
cand AS (SELECT * FROM c WHERE {where}),
span AS (SELECT epoch(min(t)) AS o, epoch(max(t)) AS w FROM cand),
known AS (SELECT * FROM cand WHERE cos >= 0.15 OR kw > 0),
best AS (SELECT coalesce(max(cos), 0) AS b FROM known),
surv AS (SELECT known.* FROM known, best WHERE b >= 0.32 OR kw > 0),
edge AS (SELECT min(cos) AS lo, max(cos) AS hi FROM surv),
s1 AS (
  SELECT surv.*, CASE WHEN hi > lo THEN (cos - lo) / (hi - lo) ELSE 1.0 END AS sem, CASE WHEN w <= o THEN 1.0 ELSE (epoch(t) - o) / (w - o) END AS rec, least(i1 / 14.0, 1.0) AS cont FROM surv, edge, span),
s2 AS (SELECT *, {blend} + 0.005 * (0.5 * rec + 0.5 * cont) AS score, greatest(least(cos, 1.0), 0.0) AS relevance FROM s1),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, t DESC, id) AS pos FROM s2){grouped("ranked", limit)}
SELECT session_rank::INT AS session_rank, ref AS session_ref, m::INT AS match, id AS unit_id, round(score, 6) AS score, round(relevance, 6) AS relevance, round(session_relevance, 6) AS session_relevance FROM found"""


def normal_path(x: str) -> str:
    raw = f"regexp_replace(trim({x}), '^file:(//)?', '', 'i')"
    decoded = f"CASE WHEN regexp_matches({raw}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN {raw} ELSE url_decode({raw}) END"
    plain = f"regexp_replace(replace({decoded}, '\\', '/'), '^/([a-zA-Z]:/)', '\\1')"
    return f"lower(regexp_replace(regexp_replace({plain}, '/+', '/', 'g'), '/$', ''))"


ORACLE_SQL: dict[str, str] = {
    "recent_sessions": f"WITH {SESSIONS} SELECT {SHOWN} FROM sessions ORDER BY t1 DESC, ref LIMIT 5",
    "recent_sessions_filtered": f"WITH {SESSIONS} SELECT {SHOWN} FROM sessions WHERE tool IN ('codex', 'cursor') AND branch IN ('main') ORDER BY t1 DESC, ref LIMIT 7",
    "all_sessions": f"WITH {SESSIONS} SELECT {SHOWN} FROM sessions",
    "session_detail_page": f"WITH {MESSAGES} SELECT ref AS session_ref, role, idx::INT AS message_index, strftime(ts, {ISO}) AS ts, CASE WHEN length(content) <= 16000 THEN content ELSE substr(content, 1, 16000) || chr(10) || '…[truncated ' || (length(content) - 16000) || ' chars]' END AS content, id FROM messages WHERE ref = 'codex:conv-1' ORDER BY messages.ts, idx, id LIMIT 4 OFFSET 1",
    "session_by_ref": f"WITH {SESSIONS} SELECT {SHOWN} FROM sessions WHERE ref = 'cursor:conv-2'",
    "manifest_resolve": f"WITH {SESSIONS} SELECT p::INT AS position, r AS session_ref, ref IS NULL AS missing, coalesce(n, 0) AS message_count FROM (VALUES (0, 'codex:conv-1'), (1, 'codex:none'), (2, 'cursor:conv-2')) w(p, r) LEFT JOIN sessions ON ref = r",
    "continuity_status": f"WITH {SESSIONS} SELECT k.tool, count(DISTINCT s.ref) AS indexed_sessions, count(m.id) AS indexed_messages, strftime(max(m.ts), {ISO}) AS newest FROM (SELECT unnest(['claude-code', 'codex', 'cursor', 'copilot', 'copilot-cli', 'opencode', 'antigravity']) AS tool) k LEFT JOIN sessions s USING (tool) LEFT JOIN messages m ON m.ref = s.ref GROUP BY k.tool",
    "table_counts": f"WITH {SESSIONS}{units(4, 2)} SELECT 'sessions' AS name, count(*) AS n FROM sessions UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'retrieval_units', count(*) FROM unit",
    "active_session": f"WITH {SESSIONS} SELECT * FROM (SELECT {SHOWN} FROM sessions WHERE t1 <= to_timestamp(1704067200 + 172800) AT TIME ZONE 'UTC' ORDER BY t1 DESC, ref LIMIT 1)",
    "message_ids": f"WITH {MESSAGES} SELECT id, ref AS session_ref, idx::INT AS message_index, sha256(content) AS content_hash FROM messages",
    "message_dedupe": f"WITH {MESSAGES} SELECT tool, count(*) AS n, count(DISTINCT id) AS ids FROM messages WHERE tool <> 'codex' GROUP BY tool",
    "first_non_null_merge": f"WITH {SESSIONS} SELECT ref AS session_ref, tool, CASE WHEN tool = 'codex' THEN 'old' ELSE branch END AS git_branch, strftime(t0, {ISO}) AS started_at, strftime(t1, {ISO}) AS last_activity_at, n AS message_count, preview FROM sessions",
    "sliding_windows_4_2": f"WITH {MESSAGES}{units(4, 2)} SELECT id AS unit_id, ref AS session_ref, i0::INT AS message_start_index, i1::INT AS message_end_index, strftime(t0, {ISO}) AS started_at, strftime(t1, {ISO}) AS ended_at, md5(content) AS content_md5, md5(body) AS searchable_md5 FROM unit",
    "sliding_windows_8_4": f"WITH {MESSAGES}{units(8, 4)} SELECT id AS unit_id, ref AS session_ref, i0::INT AS message_start_index, i1::INT AS message_end_index, strftime(t0, {ISO}) AS started_at, strftime(t1, {ISO}) AS ended_at, md5(content) AS content_md5, md5(body) AS searchable_md5 FROM unit",
    "window_diff": f"WITH {MESSAGES}, early AS (SELECT * FROM messages WHERE idx < 4){units(4, 2)}{units(4, 2, 'early', '0')} SELECT 'delete' AS action, id AS unit_id, ref AS session_ref FROM unit0 WHERE id NOT IN (SELECT id FROM unit) UNION ALL SELECT 'insert', id, ref FROM unit WHERE id NOT IN (SELECT id FROM unit0)",
    "unvectorized_backlog": f"WITH {MESSAGES}{units(4, 2)} SELECT id AS unit_id, ref AS session_ref FROM unit WHERE tool NOT IN ('codex', 'cursor')",
    "tokenize_documents": f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {terms('coalesce(text, ' + repr('') + ')')} AS t FROM documents)",
    "term_stats": f"WITH {MESSAGES}{units(4, 2)}{INDEX} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM occ GROUP BY term",
    "bm25_topk": f"WITH {MESSAGES}{units(4, 2)}{INDEX}{bm25(WORDS)} SELECT id AS unit_id, round(bm25, 6) AS bm25 FROM scored ORDER BY round(bm25, 6), id LIMIT 20",
    "phrase_match": f"WITH {MESSAGES}{units(4, 2)}{INDEX}{bm25(PAIRS)} SELECT id AS unit_id, round(bm25, 6) AS bm25 FROM scored",
    "keyword_search": f"""WITH {SESSIONS}{units(4, 2)}{INDEX}{bm25(WORDS)},
top AS (SELECT u.*, s.n, row_number() OVER (ORDER BY bm25, u.t1 DESC, u.id) AS pos FROM scored JOIN unit u USING (id) JOIN sessions s ON s.ref = u.ref ORDER BY bm25, u.t1 DESC, u.id LIMIT 15),
sc AS (SELECT *, 1.0 / pos AS kw, CASE WHEN max(t1) OVER () > min(t1) OVER () THEN (epoch(t1) - epoch(min(t1) OVER ())) / (epoch(max(t1) OVER ()) - epoch(min(t1) OVER ())) ELSE 1.0 END AS rec, CASE WHEN n <= 1 THEN 1.0 ELSE least(i1 / (n - 1.0), 1.0) END AS cont, NULL::DOUBLE AS relevance FROM top),
ranked AS (SELECT *, 0.75 * kw + 0.15 * rec + 0.1 * cont AS score FROM sc){grouped("ranked", 5)}
SELECT session_rank::INT AS session_rank, ref AS session_ref, m::INT AS match, id AS unit_id, floor(kw * 1000 + 0.5) / 1000 AS keyword_score, floor(rec * 1000 + 0.5) / 1000 AS recency_score, floor(cont * 1000 + 0.5) / 1000 AS continuity_score, round(session_score, 6) AS session_score FROM found""",
    "cosine_topk": f"WITH {VECTOR} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS cosine FROM v, q0 ORDER BY 2 DESC, 1 LIMIT 25",
    "vector_search": semantic("q0", 5),
    "vector_search_one": semantic("q0", 1, "tool IN ('codex', 'cursor')"),
    "hybrid_search": semantic("q0", 5, keywords=True),
    "confidence_gate_empty": semantic("far", 5, "cos < 0.3"),
    "confidence_gate_keywords": semantic("far", 5, "cos < 0.3", True),
    "mean_pool_renorm": "WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL) SELECT label, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m",
    "scalar_functions": rf"""SELECT doc_id, (ceil(length(text) / 4) + ceil(len(regexp_extract_all(text, '[{{}}\[\]();=+\-*&|<>!]')) / 2))::INT AS tokens, md5(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240)) AS preview_md5,
  (CASE WHEN length(text) <= 16000 THEN length(text) ELSE 16000 + length(chr(10) || '…[truncated ' || (length(text) - 16000) || ' chars]') END)::INT AS cut_length,
  CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '…' END AS echo, floor(n_chars / 977 * 1000 + 0.5) / 1000 AS score FROM documents""",
    "iso_times": f"SELECT event_id, strftime(ts, {ISO}) AS iso FROM events",
    "path_scope": f"WITH p AS (SELECT url AS path FROM pages UNION SELECT unnest(['file:///c:/Work/App/src', 'C:\\Work\\App', '/c:/work/app/', 'c:/work/apple', '//srv//share/', '/home/me/a%20b', '/home/me/50%', '/home/me/a+b', 'c:/work/app'])), n AS (SELECT path, {normal_path('path')} AS normal FROM p) SELECT path, normal, normal = 'c:/work/app' OR starts_with(normal, 'c:/work/app/') AS inside, regexp_replace(regexp_replace(path, '[:/\\\\]', '-', 'g'), '-+$', '') AS encoded FROM n",
    "sanitize_errors": r"""SELECT page_id, regexp_replace(regexp_replace('cannot open /var/data/x.db or C:\tmp\y: ''' || url || '''', '[A-Za-z]:[/\\][^\s''"`]+', '<path>', 'g'), '(^|[\s''"`(])/[^\s''"`):]+', '\1<path>', 'g') AS said FROM pages""",
    "running_index": "SELECT event_id, user_id, coalesce(sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS message_index FROM events",
    "forward_fill_state": "SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS state FROM events",
    "incremental_cutoff": "SELECT 'since' AS run, event_type AS tool, count(*) AS n, min(event_id) AS first FROM events WHERE ts > TIMESTAMP '2024-01-15' GROUP BY ALL UNION ALL SELECT 'full', event_type, count(*), min(event_id) FROM events GROUP BY ALL",
    "cursor_advance": f"SELECT event_type AS tool, strftime(greatest(max(ts) - INTERVAL 1 SECOND, TIMESTAMP '1970-01-01'), {ISO}) AS last_timestamp FROM events GROUP BY 1",
    "late_rows": "WITH c AS (SELECT event_type, max(ts) - INTERVAL 1 SECOND AS last FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT event_type AS tool, count(*) AS n FROM events JOIN c USING (event_type) WHERE ts <= last GROUP BY 1",
    "json_shape_fingerprint": "WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events), s AS (SELECT DISTINCT event_type, k || ': ' || CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS shape FROM k) SELECT event_type AS record_type, string_agg(shape, chr(10) ORDER BY shape) AS shapes FROM s GROUP BY 1",
    "drift_summary": "SELECT event_type AS tool, 'no field ' || event_id % 3 AS surprise, 'events:' || min(event_id) AS first_location, count(*) AS records FROM events GROUP BY 1, 2",
    "ranking_metrics": """WITH q AS (SELECT vec_id AS qid, label AS ql, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id, label = ql AS ok, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS c FROM embeddings JOIN q ON vec_id <> qid),
r AS (SELECT qid, ok, row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) AS rank FROM s),
f AS (SELECT qid, min(rank) AS rank FROM r WHERE rank <= 10 AND ok GROUP BY qid)
SELECT floor(avg(coalesce(1.0 / rank, 0)) * 1000 + 0.5) / 1000 AS mrr, floor(avg(coalesce((rank <= 5)::INT, 0)) * 1000 + 0.5) / 1000 AS recall_at_5, floor(avg(coalesce((rank = 1)::INT, 0)) * 1000 + 0.5) / 1000 AS top1 FROM q LEFT JOIN f USING (qid)""",
    "canary": f"WITH {MESSAGES}, n AS (SELECT to_timestamp(1704067200 + 360000) AT TIME ZONE 'UTC' AS now), a AS (SELECT tool, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (ts <= now AND now - ts <= INTERVAL 10 MINUTE) AS recent FROM chunks, n GROUP BY tool) SELECT *, users > 0 AND assistants > 0 AND recent > 0 AS passed FROM a",
}
