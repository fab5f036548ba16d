"""DuckDB SQL for the queries of staged sources."""

from __future__ import annotations

from palimpsest.functions.text import CONDENSED_MARK, WINDOW_MARK
from palimpsest.plans.oracles import _AND, _NEAR, _PHRASE, CONV, HASHED, JOBS, MESSAGES, SEMANTIC

TURNS = "t AS (SELECT *, 1700000000.0::DOUBLE + 3600 * conv_id + 60 * turn AS time FROM conversations)"
#: What a session's messages come to: their number, a digest of them, and a title from the first of the user's.
SAID = "count(*) AS n_messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS said_sha256"
FIRST = r"substring(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '\s+', ' ', 'g')), 1, 120)"
NORMAL = """n AS (
  SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'chatgpt' ELSE 'grok' END AS source, CASE WHEN conv_id % 3 = 0 THEN 'desk' END AS source_instance,
    CASE WHEN conv_id % 3 = 0 THEN (CASE WHEN conv_id % 2 = 0 THEN 'chatgpt' ELSE 'grok' END) || ':desk:' || conv_id WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'grok:' || conv_id END AS conversation_id
  FROM t
)"""
ASCII = r"d AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM documents)"
SHOWN = "coalesce(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY place) FILTER (WHERE trim(text) <> ''), '')"
EXPORT = """x AS (
  SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN text || chr(10) || 'file_' || (conv_id % 7) || 'x' ELSE text END AS text, CASE WHEN role <> 'system' THEN time END AS time,
    row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, time, turn) - 1 AS place, CAST(floor(conv_id / 64) AS BIGINT) AS part
  FROM t
)"""

ORACLES: dict[str, str] = {
    "rollout_sessions": f"""WITH {TURNS}, m AS (SELECT conv_id, {SAID}, coalesce(nullif({FIRST}, ''), 'Codex session') AS title FROM t WHERE role <> 'system' GROUP BY 1),
s AS (SELECT conv_id, min(time) AS a, max(time) AS b FROM t GROUP BY 1)
SELECT '/r/' || s.conv_id || '.jsonl' AS path, s.conv_id % 10 = 7 AS failed, CASE WHEN ok THEN 's-' || s.conv_id END AS source_conversation_id, CAST(NULL AS VARCHAR) AS source_instance, CASE WHEN ok THEN title END AS title,
  CASE WHEN ok THEN a END AS create_time, CASE WHEN ok THEN b END AS update_time, CASE WHEN ok THEN 'm' || (s.conv_id % 3) END AS model, CASE WHEN ok THEN n_messages END AS n_messages, CASE WHEN ok THEN said_sha256 END AS said_sha256
FROM (SELECT *, conv_id % 10 <> 7 AND conv_id IN (SELECT conv_id FROM m) AS ok FROM s) s LEFT JOIN m USING (conv_id)""",
    "rollout_sessions_since": f"""WITH {TURNS}, s AS (SELECT conv_id, max(time) AS b, bool_or(role <> 'system') AS any_said FROM t GROUP BY 1)
SELECT '/r/' || conv_id || '.jsonl' AS path, conv_id % 10 = 7 AS failed FROM s WHERE conv_id % 10 = 7 OR (any_said AND b >= 1700090000)""",
    "object_sessions": f"""WITH {TURNS}, m AS (SELECT conv_id, {SAID}, coalesce(nullif({FIRST}, ''), 'Gemini CLI session') AS title, max(CASE WHEN role = 'assistant' THEN 'g' END) AS model FROM t WHERE role <> 'system' GROUP BY 1),
s AS (SELECT DISTINCT conv_id FROM t)
SELECT '/g/session-' || s.conv_id || '.json' AS path, false AS failed, CASE WHEN n_messages > 0 THEN 'g-' || s.conv_id END AS source_conversation_id, CASE WHEN n_messages > 0 THEN 'gemini-cli' END AS source_instance, title,
  CASE WHEN n_messages > 0 THEN 1700000000.0::DOUBLE + 3600 * s.conv_id END AS create_time, CAST(NULL AS DOUBLE) AS update_time, model, n_messages, said_sha256
FROM s LEFT JOIN m USING (conv_id)""",
    "brain_transcripts": f"""WITH {TURNS}, u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 5 ORDER BY turn) AS k FROM t WHERE role <> 'system'),
m AS (SELECT conv_id, {SAID}, coalesce(nullif({FIRST}, ''), 'Antigravity conversation') AS title FROM u WHERE k = 1 GROUP BY 1), s AS (SELECT conv_id, min(time) AS a, max(time) AS b, max(CASE WHEN role = 'assistant' THEN 'a' END) AS model FROM u GROUP BY 1)
SELECT '/h/brain/b-' || conv_id || '/logs/transcript.jsonl' AS path, false AS failed, CASE WHEN n_messages IS NULL THEN NULL WHEN conv_id % 3 = 0 THEN 'own-' || conv_id ELSE first_id END AS source_conversation_id, CAST(NULL AS VARCHAR) AS source_instance,
  CASE WHEN conv_id % 3 = 0 AND n_messages > 0 THEN 'T' || conv_id ELSE title END AS title, a AS create_time, b AS update_time, model, n_messages, said_sha256
FROM (SELECT conv_id, 'b-' || conv_id AS first_id FROM t GROUP BY 1) LEFT JOIN s USING (conv_id) LEFT JOIN m USING (conv_id)""",
    "rollout_ids": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lpad(upper(to_hex(doc_id)), 8, '0') || '-0000-4000-8000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS own_id FROM documents",
    "exported_conversations": f"""WITH {TURNS}, {EXPORT} SELECT CAST(conv_id AS VARCHAR) AS conversation_id, part % 2 AS archive_id, 'Conversations__x-' || lpad(CAST(part AS VARCHAR), 8, '0') || '.zip' AS archive_member,
  CASE WHEN conv_id % 5 = 0 THEN '(untitled conversation)' ELSE 'T' || conv_id END AS title, 1700000000.0::DOUBLE + 3600 * conv_id AS create_time, 'm' || (conv_id % 3) AS default_model_slug, count(*) AS message_count, sha256({SHOWN}) AS transcript_sha256
FROM x GROUP BY conv_id, part""",
    "exported_messages": f"WITH {TURNS}, {EXPORT} SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'm' || lpad(CAST(turn AS VARCHAR), 4, '0') AS message_id, role, place AS turn_index, time AS create_time FROM x",
    "exported_attachments": """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || ':' || token AS attachment_id, 'u/' || token || '.wav' AS archive_path, 'wav' AS extension, token AS source_ref
FROM (SELECT conv_id, 'file_' || (conv_id % 7) || 'x' AS token FROM conversations WHERE turn = 0 AND (conv_id % 7) % 2 = 0)""",
    "content_texts": r"""WITH s AS (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN [t, 'tail', t] WHEN 1 THEN [t] WHEN 2 THEN [lang, t, 'u', 'd.org'] WHEN 3 THEN [t] WHEN 4 THEN [t, 'q'] ELSE [] END AS parts FROM s),
e AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM p), f AS (SELECT doc_id, x, min(i) AS i FROM e WHERE x <> '' GROUP BY 1, 2),
g AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS said FROM f GROUP BY 1),
k AS (SELECT doc_id, list_sort(list_distinct(list_append(regexp_extract_all(text, 'file_[A-Za-z0-9_-]*'), 'file_' || (doc_id % 9) || 'z'))) AS tokens FROM documents)
SELECT k.doc_id, sha256(coalesce(said, '')) AS said_sha256, array_to_string(CASE WHEN k.doc_id % 6 = 5 THEN ['file_' || (k.doc_id % 9) || 'z'] ELSE tokens END, ',') AS tokens FROM k LEFT JOIN g USING (doc_id)""",
    "normalized_conversations": f"""WITH {TURNS}, {NORMAL}, p AS (SELECT *, turn AS place FROM n)
SELECT conversation_id, source, source_instance, 'T' || conv_id AS title, max(time) AS update_time, count(*) AS message_count, count(*) FILTER (WHERE role = 'user') AS user_message_count, count(*) FILTER (WHERE role = 'assistant') AS assistant_message_count,
  sha256({SHOWN}) AS transcript_sha256, '{{"k": ' || conv_id || '}}' AS raw, true AS digest_holds FROM p GROUP BY conv_id, conversation_id, source, source_instance""",
    "normalized_messages": f"WITH {TURNS}, {NORMAL} SELECT conversation_id, 'm' || turn AS message_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, time AS create_time FROM n",
    "repeated_in_one_batch": f"WITH {TURNS}, {NORMAL} SELECT conversation_id, 'T' || conv_id AS title, max(time) AS update_time FROM n GROUP BY conv_id, conversation_id",
    "colliding_messages": f"WITH {TURNS}, {NORMAL} SELECT conversation_id FROM n GROUP BY conv_id, conversation_id HAVING count(*) > 1 AND conversation_id LIKE '%5'",
    "index_after_reimport": f"""WITH {TURNS}, {NORMAL} SELECT DISTINCT conversation_id, CASE WHEN conv_id % 6 = 0 THEN 'new T' ELSE 'T' END || conv_id AS title, CAST(CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS archive_id,
  conv_id % 6 <> 0 AS summarised, CASE WHEN conv_id % 6 <> 0 THEN 'extractive-v1' END AS summary_model FROM n""",
    "index_queue_after_reimport": f"""WITH {TURNS}, {NORMAL}, k AS (SELECT DISTINCT conv_id, conversation_id FROM n)
SELECT conversation_id, 'summary' AS kind, CASE WHEN conv_id % 6 = 0 THEN 'pending' ELSE 'complete' END AS status, CAST(1 AS BIGINT) AS attempts, true AS was_completed FROM k
UNION ALL SELECT conversation_id, 'embedding', 'pending', 0, false FROM k""",
    "index_from_backup": f"""WITH {TURNS}, {NORMAL} SELECT conversation_id, 'm' || turn AS message_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM n
UNION ALL SELECT 'run', 'normalized_import', 'complete', 1""",
    "streamed_conversations": f"""WITH {TURNS}, {NORMAL} SELECT conversation_id, CASE WHEN conv_id % 6 = 0 THEN 'new T' ELSE 'T' END || conv_id AS title, count(*) AS message_count,
  (SELECT count(DISTINCT conv_id) + count(DISTINCT CASE WHEN conv_id % 6 = 0 THEN conv_id END) FROM n) AS n_taken FROM n GROUP BY conv_id, conversation_id""",
    "index_get_conversation": f"""WITH {TURNS}, {NORMAL}, o AS (SELECT *, row_number() OVER (ORDER BY turn) - 1 AS k FROM n WHERE conv_id = 3)
SELECT conversation_id, 'T3' AS title, 'desk' AS source_instance, string_agg(k || ':m' || turn || ':' || role, ',' ORDER BY k) AS messages, '{{"k": 3}}' AS raw_json, CAST(0 AS INTEGER) AS n_attachments FROM o GROUP BY conversation_id""",
    "written_summaries": f"""WITH {CONV} SELECT conversation_id, CASE WHEN e THEN 'about ' || conv_id END AS abstract, CASE WHEN e THEN 'm1' END AS summary_model, CASE WHEN e THEN 'employer_sensitive' ELSE risk_flags END AS risk_flags,
  CASE WHEN e THEN 'c' || conv_id ELSE topic_tags END AS topic_tags, CASE WHEN e THEN 'r' || conv_id ELSE '' END AS redaction_notes FROM (SELECT *, conv_id % 2 = 0 AS e FROM conv)""",
    "invariant_violations": f"""WITH {JOBS}, kept AS (SELECT conversation_id FROM conv WHERE conv_id % 5 <> 1), twice AS (SELECT count(*) AS n FROM conv WHERE conv_id % 10 = 2)
SELECT 'conversations.conversation_id unique' AS "check", n AS violations FROM twice UNION ALL SELECT 'conversations identity unique', n FROM twice
UNION ALL SELECT 'messages unique', count(*) FROM msg WHERE message_id LIKE '%-1' UNION ALL SELECT 'attachments unique', 0 UNION ALL SELECT 'jobs unique', 0
UNION ALL SELECT 'messages have conversations', CAST(coalesce(sum(CASE WHEN message_id LIKE '%-1' THEN 2 ELSE 1 END), 0) AS BIGINT) FROM msg WHERE conversation_id NOT IN (SELECT conversation_id FROM kept)
UNION ALL SELECT 'attachments have conversations', count(*) FROM msg WHERE conversation_id NOT IN (SELECT conversation_id FROM kept)
UNION ALL SELECT 'jobs have conversations', count(*) FROM jobs WHERE conversation_id NOT IN (SELECT conversation_id FROM kept)""",
    "input_windows": f"""WITH {ASCII} SELECT doc_id, sha256(substring(text, 1, 300)) AS head_sha256,
  sha256(CASE WHEN length(text) <= 401 THEN text ELSE substring(text, 1, 200) || chr(10) || chr(10) || '{WINDOW_MARK}' || chr(10) || chr(10) || right(text, 200) END) AS window_sha256 FROM d""",
    "condensed_texts": rf"""WITH {ASCII}, l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), lambda x: substring(x, 1, 40)) AS w FROM d)
SELECT doc_id, sha256(array_to_string(CASE WHEN len(w) > 8 THEN list_concat(w[1:4], ['{CONDENSED_MARK}'], w[len(w) - 3:len(w)]) ELSE w END, chr(10))) AS condensed_sha256 FROM l""",
    "chunked_texts": rf"""WITH RECURSIVE {ASCII}, b AS (SELECT doc_id, regexp_replace(text, '([^\n]{{90}})', '\1' || chr(10), 'g') AS text FROM d),
l AS (SELECT doc_id, CASE WHEN w[len(w)] = '' THEN w[1:len(w) - 1] ELSE w END AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM b)),
c AS (SELECT doc_id, w, 1 AS i, 0 AS k, 0 AS used FROM l UNION ALL
  SELECT doc_id, w, i + 1, CASE WHEN used + length(w[i]) + 1 > 400 THEN k + 1 ELSE k END, CASE WHEN used + length(w[i]) + 1 > 400 THEN length(w[i]) + 1 ELSE used + length(w[i]) + 1 END FROM c WHERE i <= len(w)),
s AS (SELECT doc_id, k, max(used) AS size FROM c WHERE i > 1 GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_chunks, CAST(max(size) AS BIGINT) AS longest FROM s GROUP BY 1""",
    "json_responses": """SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN '{"id": ' || doc_id || '}' END AS found FROM documents""",
    "asset_index": """WITH p AS (SELECT DISTINCT 'd' || (doc_id % 3) || '/file_' || (doc_id % 40) || '-a/file_' || (doc_id % 2) || '.png' AS path, 'file_' || (doc_id % 40) || '-a' AS a, 'file_' || (doc_id % 2) AS b FROM documents)
SELECT token, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT a AS token, path FROM p UNION SELECT b, path FROM p) GROUP BY 1""",
    "embedding_codec": "SELECT vec_id, 4 * len(embedding) AS n_bytes, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings",
    "unit_embedding": f"""WITH {CONV}, {HASHED.format(text='transcript_text', rows='conv')}, n AS (SELECT conversation_id, sqrt(sum(weight * weight)) AS n FROM hashed GROUP BY 1)
SELECT conversation_id, bucket, round(weight / n, 4) AS value FROM hashed JOIN n USING (conversation_id) WHERE weight <> 0""",
    "fts_written_and": _AND,
    "fts_written_phrase": _PHRASE,
    "fts_written_near": _NEAR,
    "fts_page": f"""WITH page AS (SELECT * FROM ({_AND}) ORDER BY score, conversation_id LIMIT 25), c AS (WITH {CONV} SELECT conversation_id, title, source FROM conv)
SELECT page.conversation_id, title, score FROM page JOIN c USING (conversation_id) WHERE source IN ('chatgpt', 'codex', 'gemini')""",
    "search_by_mode": f"""WITH m AS (WITH {CONV} SELECT conversation_id FROM conv ORDER BY coalesce(update_time, create_time) DESC NULLS LAST, conversation_id LIMIT 25),
s AS (WITH {SEMANTIC} SELECT conversation_id FROM sim ORDER BY score DESC, conversation_id LIMIT 7)
SELECT 'default' AS search, conversation_id FROM m UNION ALL SELECT 'told', conversation_id FROM m UNION ALL SELECT 'semantic', conversation_id FROM s""",
}
