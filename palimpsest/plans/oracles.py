"""DuckDB SQL that restates the registered queries independently of the Spark plans."""

from __future__ import annotations

IDS = r"""
src AS (
  SELECT conv_id, turn, role, text, ['chatgpt', 'codex', 'gemini', 'antigravity'][CAST(conv_id % 4 AS INTEGER) + 1] AS source FROM conversations
), ids AS (
  SELECT *, CASE WHEN source = 'gemini' THEN 'gemini-cli' END AS source_instance,
    CASE source WHEN 'chatgpt' THEN '' WHEN 'gemini' THEN 'gemini:gemini-cli:' ELSE source || ':' END || CAST(conv_id AS VARCHAR) AS conversation_id
  FROM src
)"""
MESSAGES = (
    IDS
    + r""", msg AS (
  SELECT conv_id, conversation_id, source, 'm-' || conv_id || '-' || turn AS message_id, role, 1700000000.0::DOUBLE + 3600 * conv_id + 60 * turn AS create_time,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, text
  FROM ids
)"""
)
CONV = (
    MESSAGES
    + r""", grp AS (
  SELECT conv_id, conversation_id, source, source_instance, count(*) AS message_count,
    count(*) FILTER (WHERE role = 'user') AS user_message_count, count(*) FILTER (WHERE role = 'assistant') AS assistant_message_count,
    max(turn) AS last_turn,
    coalesce(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE regexp_replace(text, '\s+', '', 'g') <> ''), '') AS transcript_text,
    arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user
  FROM ids GROUP BY ALL
), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
conv AS (
  SELECT g.*, CASE WHEN coalesce(trim(regexp_replace(first_user, '\s+', ' ', 'g')), '') = '' THEN '(untitled conversation)'
      ELSE substring(trim(regexp_replace(first_user, '\s+', ' ', 'g')), 1, 120) END AS title,
    1700000000.0::DOUBLE + 3600 * conv_id AS create_time,
    CASE WHEN conv_id % 5 <> 0 THEN 1700000000.0::DOUBLE + 3600 * conv_id + 60 * last_turn END AS update_time,
    CASE WHEN conv_id % 7 <> 0 THEN 'model-' || (conv_id % 3) END AS default_model_slug,
    't' || (conv_id % 2) || ',u' || (conv_id % 3) AS topic_tags,
    CASE WHEN t.doc_id IS NOT NULL THEN 'contains_pii' ELSE '' END AS risk_flags,
    substring(transcript_text, 1, 5000) AS transcript_digest
  FROM grp g LEFT JOIN toxic t ON t.doc_id = g.conv_id
)"""
)
JOBS = (
    CONV
    + r""", jobs AS (
  SELECT conversation_id, kind, ['pending', 'running', 'complete', 'failed'][CAST(conv_id % 4 AS INTEGER) + 1] AS status, conv_id % 3 AS attempts,
    1700000000 + 600 * conv_id AS updated_at, conv_id
  FROM conv, (VALUES ('summary'), ('embedding')) k(kind)
  WHERE (kind = 'summary' AND conv_id % 3 <> 0) OR (kind = 'embedding' AND conv_id % 2 = 0)
), worked AS (
  SELECT *, conv_id % 4 = 1 AS has_summary, conv_id % 8 = 1 AS has_embedding FROM conv
)"""
)
BRIEF = "conversation_id, source, title, create_time, update_time, default_model_slug, risk_flags, topic_tags"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
POSTINGS = (
    CONV
    + rf""", tok AS (
  SELECT conversation_id, c.col AS col, regexp_extract_all(strip_accents(lower(c.body)), '{TOKEN}') AS terms
  FROM conv, LATERAL (VALUES ('title', title), ('transcript_text', transcript_text), ('summary_text', ''),
    ('topic_tags', '["' || replace(topic_tags, ',', '","') || '"]')) c(col, body)
), post AS (
  SELECT conversation_id, col, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM tok
), len AS (SELECT conversation_id, CAST(sum(len(terms)) AS DOUBLE) AS d FROM tok GROUP BY conversation_id),
corpus AS (SELECT count(*) AS n, avg(d) AS avgdl FROM len)"""
)


def _bm25(phrases: list[str], holds: str, scoring: list[int] | None = None, plain: list[str] | None = None) -> str:
    """phrases: SQL that gives (conversation_id, f) of each; holds: a condition over f0, f1, ...; plain: where document
    counts come from, if not from the same."""
    scoring = list(range(len(phrases))) if scoring is None else scoring
    ctes = "".join(f", p{i} AS ({sql})" for i, sql in enumerate(phrases))
    joins = " ".join(f"LEFT JOIN p{i} ON p{i}.conversation_id = l.conversation_id" for i in range(len(phrases)))
    cols = ", ".join(f"coalesce(p{i}.f, 0) AS f{i}, (SELECT count(*) FROM {f'({plain[i]})' if plain else f'p{i}'}) AS df{i}" for i in range(len(phrases)))
    terms = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(coalesce(nullif(greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0), 0), 1e-6), 0) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avgdl)) ELSE 0 END" for i in scoring)
    return f"WITH {POSTINGS}{ctes}, f AS (SELECT l.conversation_id, l.d, {cols} FROM len l {joins}) SELECT conversation_id, round(-({terms}), 6) AS score FROM f, corpus WHERE {holds}"


def _term(condition: str) -> str:
    return f"SELECT conversation_id, count(*) AS f FROM post WHERE {condition} GROUP BY conversation_id"


def _near(side: str) -> str:
    """Occurrences of either word with at most 12 tokens to one of the other."""
    return f"SELECT conversation_id, count(*) AS f FROM (SELECT DISTINCT a.conversation_id, a.col, {side}.pos FROM post a JOIN post b ON a.conversation_id = b.conversation_id AND a.col = b.col AND a.term = 'thing' AND b.term = 'from' AND abs(a.pos - b.pos) <= 13) GROUP BY 1"


_AND = _bm25([_term("term = 'thing'"), _term("term = 'from'")], "f0 > 0 AND f1 > 0")
_PHRASE = _bm25(["SELECT a.conversation_id, count(*) AS f FROM post a JOIN post b ON a.conversation_id = b.conversation_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1"], "f0 > 0")
_NEAR = _bm25([_near("a"), _near("b")], "f0 > 0", None, [_term("term = 'thing'"), _term("term = 'from'")])


def _targets(kind: str, where: str, chars: str, limit: int) -> str:
    return f"""WITH {JOBS} SELECT conversation_id, row_number() OVER (ORDER BY a, {chars} create_time DESC NULLS LAST, conversation_id) AS place FROM (
  SELECT w.conversation_id, coalesce(j.attempts, 0) AS a, length(transcript_text) AS n_chars, create_time, w.conv_id
  FROM worked w LEFT JOIN jobs j ON j.conversation_id = w.conversation_id AND j.kind = '{kind}' WHERE {where}
) QUALIFY place <= {limit}"""


KNN = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = {own})
SELECT CAST(vec_id AS VARCHAR) AS conversation_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q {where}
ORDER BY list_cosine_similarity(v.e, q.e) DESC, CAST(vec_id AS VARCHAR) LIMIT {limit}"""

HASHED = r"""
toks AS (
  SELECT conversation_id, list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: length(x) > 1) AS w FROM {rows}
), feat AS (
  SELECT conversation_id, unnest(w) AS feature, 1.0::DOUBLE AS weight FROM toks
  UNION ALL
  SELECT conversation_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || '::' || p[2])) AS feature, 1.5::DOUBLE AS weight FROM toks WHERE len(w) > 1
), hashed AS (
  SELECT conversation_id, CAST(('0x' || substring(sha256(feature), 1, 2)) AS BIGINT) AS bucket,
    sum(CASE WHEN CAST(('0x' || substring(sha256(feature), 17, 2)) AS BIGINT) % 2 = 0 THEN weight ELSE -weight END) AS weight
  FROM feat GROUP BY 1, 2
)"""
SEMANTIC = (
    CONV
    + ", every AS (SELECT conversation_id, transcript_text AS body FROM conv UNION ALL SELECT '?', 'thing from'), "
    + HASHED.format(text="body", rows="every")
    + """, norm AS (SELECT conversation_id, sqrt(sum(weight * weight)) AS n FROM hashed GROUP BY 1),
sim AS (
  SELECT c.conversation_id, c.source, c.title,
    coalesce((SELECT sum(h.weight * q.weight) FROM hashed h JOIN hashed q ON q.bucket = h.bucket AND q.conversation_id = '?' WHERE h.conversation_id = c.conversation_id)
      / (SELECT n FROM norm WHERE norm.conversation_id = c.conversation_id) / (SELECT n FROM norm WHERE norm.conversation_id = '?'), 0) AS score
  FROM conv c
)"""
)
TRIM = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"

ORACLES: dict[str, str] = {
    "metadata_search": f"WITH {CONV} SELECT {BRIEF} FROM conv ORDER BY coalesce(update_time, create_time) DESC NULLS LAST, conversation_id LIMIT 25",
    "metadata_search_filtered": f"""WITH {CONV} SELECT {BRIEF} FROM (SELECT * FROM conv ORDER BY coalesce(update_time, create_time) DESC NULLS LAST, conversation_id LIMIT 40)
WHERE source IN ('chatgpt', 'codex', 'gemini') AND default_model_slug = 'model-1' AND topic_tags LIKE 't1,%'""",
    "filter_all_tags": f"WITH {CONV} SELECT conversation_id, topic_tags FROM conv WHERE topic_tags = 't1,u2'",
    "filter_risk_flags": f"WITH {CONV} SELECT conversation_id, risk_flags FROM conv WHERE risk_flags = 'contains_pii'",
    "date_range": f"WITH {CONV} SELECT conversation_id, coalesce(update_time, create_time, 0.0) AS effective_time FROM conv WHERE coalesce(update_time, create_time, 0.0) BETWEEN 1700030000 AND 1700300000",
    "transcript": f"WITH {CONV} SELECT conversation_id, sha256(transcript_text) AS transcript_sha256, length(transcript_text) AS n_chars FROM conv",
    "digest_title": f"WITH {CONV} SELECT conversation_id, title, sha256(transcript_digest) AS digest_sha256 FROM conv",
    "message_counts": f"WITH {CONV} SELECT conversation_id, message_count, user_message_count, assistant_message_count FROM conv",
    "turn_index": f"WITH {MESSAGES} SELECT conversation_id, message_id, turn_index FROM msg",
    "canonical_id": """SELECT doc_id, CASE WHEN s = 'chatgpt' AND i IS NULL THEN d WHEN coalesce(i, '') <> '' THEN s || ':' || i || ':' || d ELSE s || ':' || d END AS conversation_id FROM (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS d, ['chatgpt', 'codex', 'gemini', 'antigravity'][CAST(doc_id % 4 AS INTEGER) + 1] AS s, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'desk' END AS i FROM documents)""",
    "detail": f"""WITH {CONV} SELECT c.conversation_id, title, message_count, (SELECT string_agg(turn_index || ':' || message_id || ':' || role, ',' ORDER BY turn_index) FROM msg m WHERE m.conversation_id = 'codex:1') AS messages,
CAST(0 AS INTEGER) AS n_attachments FROM conv c WHERE c.conversation_id = 'codex:1'""",
    "session_span": f"WITH {MESSAGES} SELECT conversation_id, min(create_time) AS create_time, max(create_time) AS update_time FROM msg GROUP BY 1",
    "first_user_message": f"WITH {MESSAGES} SELECT conversation_id, arg_min(message_id, turn_index) AS message_id, substring(trim(regexp_replace(arg_min(text, turn_index), '\\s+', ' ', 'g')), 1, 120) AS title FROM msg WHERE role = 'user' GROUP BY 1",
    "embedding_input": f"""WITH {CONV} SELECT conversation_id, sha256('Title: ' || title || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'Abstract: about ' || title || chr(10) || 'Key points: k1; k2' || chr(10) || 'Topics: ' || replace(topic_tags, ',', ', ') || chr(10) ELSE '' END
|| 'Transcript digest: ' || transcript_digest) AS input_sha256 FROM conv""",
    "stats_global": f"""WITH {JOBS} SELECT (SELECT count(*) FROM conv) AS conversations, (SELECT max(update_time) FROM conv) AS latest_update_time, (SELECT count(*) FROM msg) AS messages, (SELECT count(*) FROM benchmark) AS attachments,
(SELECT count(*) FROM jobs WHERE kind = 'summary' AND status = 'complete') AS summaries_complete, (SELECT count(*) FROM jobs WHERE kind = 'embedding' AND status = 'complete') AS embeddings_complete,
(SELECT url FROM pages ORDER BY page_id DESC LIMIT 1) AS archive_path""",
    "count_by_source": f"WITH {CONV} SELECT source, count(*) AS conversations FROM conv GROUP BY source",
    "source_health": f"""WITH {CONV} SELECT c.source, count(DISTINCT c.conversation_id) AS conversations, count(m.message_id) AS messages, max(c.update_time) AS newest_update_time
FROM conv c LEFT JOIN (SELECT * FROM msg WHERE role <> 'system') m ON m.conversation_id = c.conversation_id GROUP BY c.source""",
    "job_progress": f"WITH {JOBS} SELECT kind, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs GROUP BY kind",
    "summary_targets": _targets("summary", "NOT has_summary", "n_chars,", 50),
    "summary_targets_forced": _targets("summary", "true", "n_chars,", 50),
    "embedding_targets": _targets("embedding", "has_summary AND NOT has_embedding", "", 50),
    "embedding_targets_forced": _targets("embedding", "true", "", 50),
    "allow_list_semi": _targets("summary", "NOT has_summary AND w.conv_id % 6 = 0", "n_chars,", 10),
    "job_upsert": f"""WITH {JOBS}, chg AS (SELECT conversation_id, 'summary' AS kind FROM conv WHERE conv_id % 2 = 1)
SELECT coalesce(j.conversation_id, c.conversation_id) AS conversation_id, coalesce(j.kind, c.kind) AS kind, CASE WHEN c.kind IS NOT NULL THEN 'complete' ELSE j.status END AS status,
  coalesce(j.attempts, 0) + CASE WHEN c.kind IS NOT NULL THEN 1 ELSE 0 END AS attempts, CASE WHEN c.kind IS NOT NULL THEN 1704067200 ELSE j.updated_at END AS updated_at,
  CASE WHEN c.kind IS NOT NULL AND j.kind IS NOT NULL THEN '1704067200' END AS completed_at
FROM jobs j FULL JOIN chg c ON c.conversation_id = j.conversation_id AND c.kind = j.kind""",
    "stale_jobs": f"""WITH {JOBS} SELECT conversation_id, kind, CASE WHEN status = 'running' AND updated_at < 1700028000 - 1200 THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'running' AND updated_at < 1700028000 - 1200 THEN 1700028000 ELSE updated_at END AS updated_at FROM jobs""",
    "upsert_changed": f"""WITH {JOBS} SELECT conversation_id, CASE WHEN conv_id % 6 = 0 THEN title || '!' ELSE title END AS title, update_time,
  CASE WHEN conv_id % 6 <> 0 AND has_summary THEN '{{"abstract_text":"x"}}' END AS summary_json, CASE WHEN conv_id % 6 = 0 THEN '' ELSE topic_tags END AS topic_tags, 'seen' AS review_status FROM worked
UNION ALL SELECT 'new:' || conversation_id, title, update_time, NULL, '', NULL FROM worked WHERE conv_id % 3 = 0""",
    "change_detection": f"WITH {CONV} SELECT conversation_id, true AS existed, conv_id % 6 = 0 AS changed FROM conv WHERE conv_id % 3 = 0 UNION ALL SELECT 'new:' || conversation_id, false, true FROM conv WHERE conv_id % 3 = 0",
    "replace_children": f"""WITH {MESSAGES} SELECT conversation_id, message_id, CASE WHEN conv_id % 3 = 0 THEN sha256('again') ELSE sha256(text) END AS text_sha256 FROM msg WHERE conv_id % 3 <> 0 OR message_id LIKE '%0'""",
    "skip_existing_anti": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "asset_links": """WITH t AS (SELECT doc_id, 'file_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-a' AS token FROM documents WHERE doc_id % 7 = 0)
SELECT CAST(doc_id AS VARCHAR) AS conversation_id, doc_id || ':' || token AS attachment_id, 'dir/' || token || '/audio.wav' AS archive_path, 'wav' AS extension, token AS source_ref FROM t""",
    "file_tokens": r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, 'file_[A-Za-z0-9_-]*'), ['file_' || doc_id || '_z', 'file_b-' || source]))), ',') AS tokens FROM documents""",
    "dedupe_join": rf"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
d AS (SELECT doc_id, {TRIM} AS x, min(i) AS i FROM p GROUP BY 1, 2)
SELECT doc_id, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE x <> ''), '')) AS joined_sha256 FROM d GROUP BY doc_id""",
    "epoch_normalise": "SELECT event_id, round(epoch_ms(ts) / 1000.0, 3) AS seconds, CASE WHEN event_id % 3 <> 0 THEN round(epoch_ms(ts) / 1000.0, 3) END AS stamp_seconds FROM events",
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "fts_tokens": rf"SELECT doc_id, len(w) AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens_sha256 FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '{TOKEN}') AS w FROM documents)",
    "fts_document_frequency": f"WITH {POSTINGS} SELECT term, count(DISTINCT conversation_id) AS df, count(*) AS cf FROM post GROUP BY term",
    "fts_and": _AND,
    "fts_or": _bm25([_term("term = 'thing'"), _term("term = 'tion'")], "f0 > 0 OR f1 > 0"),
    "fts_not": _bm25([_term("term = 'tion'"), _term("term = 'thing'")], "f0 > 0 AND f1 = 0", [0]),
    "fts_phrase": _PHRASE,
    "fts_prefix": _bm25([_term("starts_with(term, 'thin')")], "f0 > 0"),
    "fts_column": _bm25([_term("term = 'the' AND col = 'title'")], "f0 > 0"),
    "fts_initial": _bm25([_term("term = 'user' AND pos = 0")], "f0 > 0"),
    "fts_near": _NEAR,
    "cosine_knn": KNN.format(own=0, where="", limit=25),
    "related": KNN.format(own=7, where="WHERE vec_id <> 7", limit=10),
    "hashed_embedding": f"WITH {CONV}, {HASHED.format(text='transcript_text', rows='conv')} SELECT conversation_id, bucket, weight FROM hashed WHERE weight <> 0",
    "semantic_search": f"WITH {SEMANTIC} SELECT conversation_id, round(score, 5) AS score FROM sim WHERE source IN ('chatgpt', 'codex') ORDER BY sim.score DESC, conversation_id LIMIT 25",
    "rank_fusion": f"""WITH {CONV}, a AS (SELECT conversation_id, row_number() OVER (ORDER BY length(transcript_text) DESC, conversation_id) AS r FROM conv QUALIFY r <= 40), b AS (SELECT conversation_id, row_number() OVER (ORDER BY create_time) AS r FROM conv QUALIFY r <= 40),
u AS (SELECT conversation_id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) SELECT conversation_id, round(s, 8) AS score FROM u ORDER BY s DESC, conversation_id LIMIT 25""",
    "hybrid_rrf": f"""WITH fts AS ({_AND}), sem AS (WITH {SEMANTIC} SELECT conversation_id, title, score FROM sim),
a AS (SELECT conversation_id, row_number() OVER (ORDER BY score, conversation_id) AS r FROM fts QUALIFY r <= 25), b AS (SELECT conversation_id, row_number() OVER (ORDER BY score DESC, conversation_id) AS r FROM sem QUALIFY r <= 25),
u AS (SELECT conversation_id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)
SELECT u.conversation_id, sem.title, round(s, 8) AS score FROM u JOIN sem USING (conversation_id) ORDER BY s DESC, u.conversation_id LIMIT 25""",
}
