"""The library's registered queries over the driver's tables, and the DuckDB SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage
from .functions import scalar, sections
from .functions.tokens import tokens
from .operators import browse, dml, index_job, ingest, paging, search, segments, topk, usage
from .plans.tables import EPOCH, RATES, Tables
from .sources import adapters
from .sources.verified import look_again
from .streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = f"""
message AS (
  SELECT ({EPOCH} + conv_id * 60000 + turn * 1000) * 1048576 AS id, conv_id // 10 AS source_file_id, conv_id AS session_id,
         ['claude', 'codex', 'gemini', 'other'][(conv_id // 10) % 4 + 1] AS agent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
         'turn-' || turn AS source_key, role, {EPOCH} + conv_id * 60000 + turn * 1000 AS ts, coalesce(text, '') AS prose, length(text) AS char_count,
         coalesce(length(text) % 11 = 0, false) AS has_error, turn % 5 = 4 AS is_sidechain
  FROM conversations),
flat AS (SELECT *, trim(regexp_replace(prose, '\\s+', ' ', 'g')) AS f FROM message),
session AS (
  SELECT session_id AS id, source_file_id, agent, min(ts) AS started_at, max(ts) AS last_activity_at, count(*) AS message_count, bool_or(has_error) AS had_error,
         arg_min(CASE WHEN length(f) > 160 THEN left(f, 159) || '…' ELSE f END, seq) FILTER (role = 'user' AND prose <> '') AS first_user_message,
         source_file_id % 7 AS project_id, 'conv-' || session_id AS external_id
  FROM flat GROUP BY session_id, source_file_id, agent),
file_id AS (SELECT DISTINCT conv_id // 10 AS id FROM conversations),
source_file AS (SELECT id, id % 4 + 1 AS root_id, ['claude', 'codex', 'gemini', 'other'][id % 4 + 1] AS agent, '/logs/' || ['claude', 'codex', 'gemini', 'other'][id % 4 + 1] || '/f' || id || '.jsonl' AS path, CASE WHEN id % 5 = 0 THEN 'unreadable' END AS last_error FROM file_id),
adapter_health AS (SELECT id AS source_file_id, {EPOCH} + id AS last_success_ms, CASE WHEN id % 6 = 1 THEN 'bad line' END AS last_error FROM file_id WHERE id % 3 <> 0),
scan_error AS (SELECT id, id % 4 + 1 AS root_id, 'sub' || id AS relative_scope, 'permission denied' AS error FROM file_id WHERE id % 4 < 2 AND id % 8 < 5),
project AS (SELECT DISTINCT id % 7 AS id, '/work/proj' || id % 7 AS canonical_key, 'Proj' || id % 7 AS display_name FROM file_id),
root(id, agent, path) AS (VALUES (1, 'claude', '/logs/claude'), (2, 'codex', '/logs/codex'), (3, 'gemini', '/logs/gemini'), (4, 'other', '/logs/other')),
observation AS (
  SELECT event_id AS id, ['claude', 'codex', 'gemini'][user_id % 3 + 1] AS agent, user_id || ':' || coalesce(json_extract_string(props, '$.k'), 'none') AS dedupe_key, epoch_us(ts) // 1000 AS ts, user_id % 7 AS project_id,
         event_type AS model, event_id % 4 = 0 AS is_sidechain, event_id % 1000 AS input_tokens, CASE WHEN event_id % 10 <> 0 THEN floor(value * 100)::BIGINT END AS output_tokens,
         CASE WHEN event_type <> 'purchase' THEN event_id % 7 END AS cache_write_tokens, event_id % 300 AS cache_read_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS reasoning_tokens
  FROM events),
canonical AS (
  SELECT agent, dedupe_key, row_number() OVER (PARTITION BY agent, dedupe_key ORDER BY coalesce(output_tokens, -1) DESC, id DESC) AS rn, ts, project_id, model, is_sidechain,
         max(input_tokens) OVER w AS input_tokens, max(output_tokens) OVER w AS output_tokens, max(cache_write_tokens) OVER w AS cache_write_tokens, max(cache_read_tokens) OVER w AS cache_read_tokens, max(reasoning_tokens) OVER w AS reasoning_tokens
  FROM observation WINDOW w AS (PARTITION BY agent, dedupe_key)),
daily AS (
  SELECT strftime(make_timestamp((ts // 1000) * 1000000), '%Y-%m-%d') AS day, project_id, model, is_sidechain, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens,
         sum(coalesce(cache_write_tokens, 0))::BIGINT AS cache_write_tokens, sum(coalesce(cache_read_tokens, 0))::BIGINT AS cache_read_tokens, sum(coalesce(reasoning_tokens, 0))::BIGINT AS reasoning_tokens
  FROM canonical WHERE rn = 1 GROUP BY ALL),
rate(model_pattern, input, output, cache_write, cache_read, extra, includes, unmetered) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if i == 0 else f"{x}::DECIMAL(12,6)" for i, x in enumerate(r)) + ")" for r in RATES)}),
rated AS (
  SELECT d.*, r.* EXCLUDE (model_pattern), r.model_pattern, row_number() OVER (PARTITION BY day, project_id, model, is_sidechain ORDER BY CASE WHEN r.model_pattern LIKE '%*' THEN length(r.model_pattern) - 1 ELSE length(r.model_pattern) + 10000 END DESC) AS best
  FROM daily d LEFT JOIN rate r ON CASE WHEN r.model_pattern LIKE '%*' THEN starts_with(lower(d.model), lower(left(r.model_pattern, length(r.model_pattern) - 1))) ELSE lower(d.model) = lower(r.model_pattern) END),
priced AS (
  SELECT *, CASE WHEN includes THEN greatest(0, input_tokens - cache_read_tokens) ELSE input_tokens END AS net_input FROM rated WHERE best = 1),
estimate AS (
  SELECT day, project_id, model, is_sidechain,
         CASE WHEN model_pattern IS NULL THEN 'unavailable' WHEN unmetered THEN 'unmetered'
              WHEN (net_input > 0 AND input IS NULL) OR (output_tokens > 0 AND output IS NULL) OR (cache_write_tokens > 0 AND cache_write IS NULL) OR (cache_read_tokens > 0 AND cache_read IS NULL) THEN 'unavailable' ELSE 'estimated' END AS status,
         (net_input * coalesce(input, 0) + output_tokens * coalesce(output, 0) + cache_write_tokens * coalesce(cache_write, 0) + cache_read_tokens * coalesce(cache_read, 0) + reasoning_tokens * coalesce(extra, 0))::DOUBLE / 1000000 AS dollars
  FROM priced),
conv_token AS (SELECT id, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM (SELECT id, regexp_extract_all(translate(lower(prose), 'äçèéêíñóöü', 'aceeeinoou'), '[\\p{{L}}\\p{{N}}]+') AS words FROM message)),
doc_token AS (SELECT id, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM (SELECT doc_id AS id, regexp_extract_all(translate(lower(text), 'äçèéêíñóöü', 'aceeeinoou'), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents WHERE trim(text) <> ''))
"""


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH {BASE} {sql}" if not sql.lstrip().startswith("--plain") else sql.replace("--plain", "", 1)
        return f

    return add


def _corpus(t: Tables) -> DataFrame:
    """Messages with what searches filter by and show: session, project, file and root."""
    s = t.session().select(F.col("id").alias("session_id"), "had_error", "project_id", "external_id")
    p = t.project().select(F.col("id").alias("project_id"), F.col("canonical_key").alias("project_key"))
    f = t.source_file().select(F.col("id").alias("source_file_id"), "path", "root_id")
    r = t.root().select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    return t.message().join(s, "session_id").join(p, "project_id").join(f, "source_file_id").join(r, "root_id", "left")


def _found(t: Tables, text: str, **options) -> DataFrame:
    index = search.stored_index(t.spark, "messages", storage.state_of(t.raw("conversations")), t.message_text(), text=F.col("prose"))
    return search.search(_corpus(t), index, t.supported(), text, **options)


_MATCH = """, hit AS (SELECT id FROM conv_token WHERE starts_with(token, 'th') INTERSECT SELECT id FROM conv_token WHERE token = 'and')
SELECT m.id, m.session_id, m.ts, m.role, m.agent, f.path, r.path AS root_path FROM message m JOIN session s ON s.id = m.session_id JOIN hit ON hit.id = m.id JOIN source_file f ON f.id = m.source_file_id LEFT JOIN root r ON r.id = f.root_id WHERE m.agent <> 'other' {} ORDER BY m.ts DESC, m.id DESC LIMIT {}"""
_RESULT = ("id", "session_id", "ts", "role", "agent", "path", "root_path")


@register(_MATCH.format("", 200))
def q1_search_recency(t):
    return _found(t, 'th "and"').select(*_RESULT)


CURSOR_TS = EPOCH + 60 * 60_000


@register(_MATCH.format(f"AND (m.ts < {CURSOR_TS} OR (m.ts = {CURSOR_TS} AND m.id < {CURSOR_TS * 1048576}))", 50))
def q1_search_next_page(t):
    return _found(t, 'th "and"', cursor=(CURSOR_TS, CURSOR_TS * 1048576), limit=50).select(*_RESULT)


@register(_MATCH.format(f"AND m.agent IN ('claude', 'codex') AND m.ts >= {EPOCH + 600000} AND m.ts <= {EPOCH + 5400000} AND (m.has_error OR s.had_error)", 200))
def q1_search_filtered(t):
    return _found(t, 'th "and"', agents=["claude", "codex"], since=EPOCH + 600_000, until=EPOCH + 5_400_000, errors_only=True).select(*_RESULT)


def _in_increments(t: Tables, rows: DataFrame) -> segments.Segments:
    """An index of ``rows(id, prose, tool_invocation, tool_output)`` made by three changes, with rows that are rewritten and rows that are deleted again."""
    log = segments.Segments(t.spark, storage.new_folder(t.spark, "segments"), fanout=2)
    early, late = rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")
    wrong = early.where("id % 2 = 0").withColumn("prose", F.concat(F.lit("the of that and "), "prose"))
    passing = early.withColumn("id", -F.col("id") - 1)
    log.update(early.where("id % 2 <> 0").unionByName(wrong).unionByName(passing))
    log.update(late)
    log.update(early.where("id % 2 = 0"), passing.select("id"))
    return log


@register(_MATCH.format("", 200))
def q1_search_over_segments(t):
    rows = t.message_text().select("id", "prose", F.lit("").alias("tool_invocation"), F.lit("").alias("tool_output"))
    return search.search(_corpus(t), _in_increments(t, rows).index(), t.supported(), 'th "and"').select(*_RESULT)


_SECTION = "CASE WHEN seq % 3 = 0 THEN 'prose' WHEN seq % 3 = 1 THEN 'invocations' ELSE 'everything' END"


@register(f""", starts AS (SELECT a.id FROM conv_token a JOIN conv_token b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND starts_with(b.token, 't')),
held AS (SELECT m.id, {_SECTION} AS least FROM message m WHERE m.id IN (SELECT id FROM starts))
SELECT scope, id FROM held, (VALUES ('prose'), ('invocations'), ('everything')) s(scope) WHERE scope = 'everything' OR least = 'prose' OR scope = least""")
def q1_scopes(t):
    """One index, three scopes: each message's text stands in one of its sections."""
    place = F.col("seq") % 3
    rows = t.message().select("id", *[F.when(place == k, F.col("prose")).otherwise("").alias(n) for k, n in enumerate(segments.WIDEST)])
    log = segments.Segments(t.spark, storage.new_folder(t.spark, "segments"))
    log.update(rows)
    phrase = search.parse_query('of-t')
    out = [search.match(log.index(scope).postings, phrase).select(F.lit(scope).alias("scope"), "id") for scope in sections.SCOPES]
    return out[0].unionByName(out[1]).unionByName(out[2])


_BM25 = """, starts AS (
  SELECT 0 AS phrase, id, pos AS start FROM doc_token WHERE token = 'the'
  UNION ALL SELECT 1, a.id, a.pos FROM doc_token a JOIN doc_token b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND starts_with(b.token, 't')),
tf AS (SELECT phrase, id, count(*) AS tf FROM starts GROUP BY ALL),
len AS (SELECT id, count(*) AS n FROM doc_token GROUP BY id),
corpus AS (SELECT count(*) AS total, (SELECT avg(coalesce(n, 0)) FROM documents d LEFT JOIN len ON len.id = d.doc_id WHERE trim(text) <> '') AS avg_len FROM documents WHERE trim(text) <> ''),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase),
idf AS (SELECT phrase, CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, corpus),
score AS (SELECT id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score FROM tf JOIN idf USING (phrase) JOIN len USING (id), corpus GROUP BY id HAVING count(*) = 2),
doc AS (SELECT doc_id AS id, doc_id // 10 AS session_id, ['claude', 'codex', 'gemini', 'other'][doc_id % 4 + 1] AS agent, '/work/proj' || (doc_id // 10) % 7 AS project_key, {EPOCH} + doc_id * 1000 AS ts, doc_id % 11 = 0 AS has_error, (doc_id // 10) % 6 = 0 AS had_error FROM documents),
ranked AS (SELECT d.id, session_id, project_key, round(score, 9) AS score, score AS exact FROM doc d JOIN score USING (id) WHERE agent <> 'other' {{}})
SELECT id, session_id, project_key, score FROM ranked {{}} ORDER BY exact, id DESC LIMIT {{}}""".replace("{EPOCH}", str(EPOCH)).replace("{{}}", "{}")


def _documents_corpus(t: Tables) -> DataFrame:
    """Documents as messages, ten to a session."""
    session = F.floor(F.col("doc_id") / 10)
    return t.raw("documents").select(
        F.col("doc_id").alias("id"), session.alias("session_id"), t.agent_of(F.col("doc_id")).alias("agent"), F.concat(F.lit("/work/proj"), F.pmod(session, F.lit(7)).cast("string")).alias("project_key"),
        (F.lit(EPOCH) + F.col("doc_id") * 1000).alias("ts"), (F.col("doc_id") % 11 == 0).alias("has_error"), (session % 6 == 0).alias("had_error"),
    )


def _documents(t: Tables, **options) -> DataFrame:
    """Documents searched by relevance; the bare term makes a phrase whose last word may go on."""
    d = t.raw("documents")
    index = search.stored_index(t.spark, "documents", storage.state_of(d), d.select(F.col("doc_id").alias("id"), "text"))
    return search.search(_documents_corpus(t), index, t.supported(), '"the" of-t', sort="relevance", **options)


_SHOWN = ("id", "session_id", "project_key")


@register(_BM25.format("", "", 200))
def q2_search_relevance(t):
    return _documents(t).select(*_SHOWN, F.round("score", 9).alias("score"))


@register(_BM25.format(f"AND agent IN ('claude', 'gemini') AND ts >= {EPOCH + 50_000} AND ts <= {EPOCH + 800_000} AND (has_error OR had_error)", "", 200))
def q2_filtered(t):
    return _documents(t, agents=["claude", "gemini"], since=EPOCH + 50_000, until=EPOCH + 800_000, errors_only=True).select(*_SHOWN, F.round("score", 9).alias("score"))


@register(_BM25.format("", "", 200))
def q2_relevance_over_segments(t):
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("prose"), F.lit("").alias("tool_invocation"), F.lit("").alias("tool_output"))
    return search.search(_documents_corpus(t), _in_increments(t, d).index(), t.supported(), '"the" of-t', sort="relevance").select(*_SHOWN, F.round("score", 9).alias("score"))


@register(_BM25.format("", "", "10 OFFSET 5"))
def q2_next_page(t):
    """The page after the first five results, by the first page's cursor."""
    first = _documents(t, limit=5)
    return _documents(t, limit=10, cursor=search.next_cursor(first, "relevance")).select(*_SHOWN, F.round("score", 9).alias("score"))


def _best_documents(t: Tables, **options) -> DataFrame:
    """As :func:`_documents`, from blocks of postings that are read only as far as the page needs."""
    d = t.raw("documents")
    ranked = topk.stored(t.spark, "documents", storage.state_of(d), d.select(F.col("doc_id").alias("id"), "text"))
    return topk.top(_documents_corpus(t), ranked, t.supported(), '"the" of-t', **options).rows.select(*_SHOWN, F.round("score", 9).alias("score"))


@register(_BM25.format("", "", 20))
def q2_best_blocks(t):
    return _best_documents(t, limit=20)


@register(_BM25.format(f"AND agent IN ('claude', 'gemini') AND ts >= {EPOCH + 50_000} AND ts <= {EPOCH + 800_000} AND (has_error OR had_error)", "", 200))
def q2_best_blocks_filtered(t):
    return _best_documents(t, agents=["claude", "gemini"], since=EPOCH + 50_000, until=EPOCH + 800_000, errors_only=True)


@register("SELECT p.id, canonical_key, display_name, count(*) AS session_count, coalesce(max(last_activity_at), 0) AS last_activity_at FROM project p JOIN session s ON s.project_id = p.id WHERE s.agent <> 'other' GROUP BY ALL")
def q3_projects(t):
    return browse.projects(t.project(), t.session(), t.supported())


def _summaries(t: Tables) -> DataFrame:
    return browse.summaries(t.session(), t.source_file(), t.project(), t.root(), t.supported())


_SUMMARY = "SELECT s.id, external_id, canonical_key AS project_key, f.path, r.path AS root_path, coalesce(first_user_message, 'Untitled session') AS resolved_title, started_at, last_activity_at, message_count, had_error FROM session s JOIN source_file f ON f.id = source_file_id JOIN project p ON p.id = project_id LEFT JOIN root r ON r.id = root_id WHERE s.agent <> 'other'"
_SUMMARY_COLS = ("id", "external_id", "project_key", "path", "root_path", "resolved_title", "started_at", "last_activity_at", "message_count", "had_error")


@register(f"{_SUMMARY} ORDER BY last_activity_at DESC, s.id DESC LIMIT 500")
def q4_sessions(t):
    return paging.page(_summaries(t), paging.SESSION_KEYS, paging.UNPAGED).select(*_SUMMARY_COLS)


@register(f"{_SUMMARY} AND canonical_key = '/work/proj1' AND (last_activity_at, s.id) < ({EPOCH + 5_000_000}, 80) ORDER BY last_activity_at DESC, s.id DESC LIMIT 5")
def q5_sessions_page(t):
    key = "/work/proj1"
    return paging.sessions_page(_summaries(t), key, 5, (key, EPOCH + 5_000_000, 80)).select(*_SUMMARY_COLS)


@register(f", top AS ({_SUMMARY} ORDER BY last_activity_at DESC, s.id DESC LIMIT 20) SELECT * FROM top UNION SELECT * FROM ({_SUMMARY} AND s.id = 2)")
def q5_session_snapshot(t):
    return paging.snapshot(_summaries(t), 2, ensure_id=2, size=10).select(*_SUMMARY_COLS)


@register("SELECT count(*) AS sessions FROM session WHERE agent <> 'other'")
def q5_sidebar_total(t):
    return browse.sidebar_total(browse.projects(t.project(), t.session(), t.supported()))


@register(f"{_SUMMARY} AND s.id = 11")
def q6_session(t):
    return _summaries(t).where(F.col("id") == 11).select(*_SUMMARY_COLS)


@register(f"SELECT id, session_id, seq, role, prose, path FROM (SELECT m.*, f.path FROM message m JOIN source_file f ON f.id = source_file_id) WHERE id = {(EPOCH + 11 * 60_000 + 1_000) << 20}")
def q6_message(t):
    return browse.message(t.message(), t.session(), t.source_file(), (EPOCH + 11 * 60_000 + 1_000) << 20).select("id", "session_id", "seq", "role", "prose", "path")


@register("SELECT id, seq, role, ts, prose, has_error FROM message WHERE session_id = 11")
def q7_transcript(t):
    return browse.transcript(t.message(), 11).select("id", "seq", "role", "ts", "prose", "has_error")


@register("SELECT session_id, source_key, ts, 'tool' AS kind, CASE WHEN length(f) > 40 THEN left(f, 39) || '…' ELSE f END AS detail FROM flat WHERE has_error AND seq % 2 = 0")
def q8_failures(t):
    return browse.failures(t.failure())


@register("SELECT * FROM daily")
def q9_usage_daily(t):
    return usage.daily(t.observations())


@register("SELECT day, 'Proj' || project_id AS project, model, is_sidechain, input_tokens, output_tokens FROM daily WHERE day >= '2024-01-03' AND day <= '2024-01-20' AND NOT is_sidechain")
def q10_usage(t):
    return usage.usage(usage.daily(t.observations()), t.usage_project(), "2024-01-03", "2024-01-20", sidechains=False).select("day", "project", "model", "is_sidechain", "input_tokens", "output_tokens")


@register("SELECT day, project_id, model, is_sidechain, status, CASE WHEN status = 'estimated' THEN round(dollars, 9) END AS amount FROM estimate")
def q11_costs(t):
    out = usage.estimate(usage.daily(t.observations()), t.rates())
    return out.select("day", "project_id", "model", "is_sidechain", "status", F.round(F.col("amount").cast("double"), 9).alias("amount"))


@register("SELECT round(sum(dollars) FILTER (status = 'estimated'), 4) AS amount, count(DISTINCT model) FILTER (status = 'unavailable') AS unavailable_models FROM estimate")
def q11_cost_totals(t):
    out = usage.totals(usage.estimate(usage.daily(t.observations()), t.rates()))
    return out.select(F.round(F.col("amount").cast("double"), 4).alias("amount"), "unavailable_models")


@register("SELECT (SELECT count(*) FROM source_file WHERE agent <> 'other') AS files, count(DISTINCT project_id) AS projects, count(*) AS sessions, sum(message_count)::BIGINT AS messages FROM session WHERE agent <> 'other'")
def q12_statistics(t):
    return browse.statistics(t.source_file(), t.session(), t.supported())


@register("""SELECT r.id AS root_id, r.agent, r.path, scan_error, coalesce(scan_errors, 0) AS scan_errors, coalesce(files, 0) AS files, file_error, coalesce(failed_files, 0) AS failed_files, last_success_ms, coalesce(sessions, 0) AS sessions, first_started_at, last_activity_at
FROM root r LEFT JOIN (SELECT root_id, max(error) AS scan_error, count(*) AS scan_errors FROM scan_error GROUP BY 1) e ON e.root_id = r.id
LEFT JOIN (SELECT root_id, count(*) AS files, max(coalesce(h.last_error, f.last_error)) AS file_error, count(coalesce(h.last_error, f.last_error)) AS failed_files, max(last_success_ms) AS last_success_ms FROM source_file f LEFT JOIN adapter_health h ON h.source_file_id = f.id GROUP BY 1) f ON f.root_id = r.id
LEFT JOIN (SELECT root_id, count(*) AS sessions, min(started_at) AS first_started_at, max(last_activity_at) AS last_activity_at FROM session s JOIN source_file f ON f.id = s.source_file_id GROUP BY 1) s ON s.root_id = r.id WHERE r.agent <> 'other'""")
def q13_source_health(t):
    return browse.source_health(t.root(), t.source_file(), t.session(), t.adapter_health(), t.scan_error(), t.supported()).drop("is_default")


@register("SELECT (SELECT count(*) FROM source_file f WHERE last_error IS NOT NULL OR id IN (SELECT source_file_id FROM adapter_health WHERE last_error IS NOT NULL)) AS failed_files, (SELECT count(*) FROM scan_error WHERE root_id IN (SELECT id FROM root)) AS failed_scans")
def q14_failure_counts(t):
    return browse.failure_counts(t.source_file(), t.adapter_health(), t.scan_error(), t.root())


@register("SELECT agent, path, 'file' AS work FROM source_file WHERE last_error IS NOT NULL UNION ALL SELECT agent, path || '/' || relative_scope, 'scope' FROM scan_error JOIN root ON root.id = root_id")
def q14_recovery_work(t):
    return browse.recovery_work(t.source_file(), t.scan_error(), t.root())


@register("SELECT s.agent, r.path AS root_path, f.path, external_id, s.id AS session_id, m.id AS message_id FROM session s JOIN source_file f ON f.id = s.source_file_id JOIN root r ON r.id = root_id JOIN message m ON m.session_id = s.id WHERE s.id = 11 AND m.seq = 2")
def q15_reference(t):
    s, m = _summaries(t), t.message()
    anchor = (EPOCH + 11 * 60_000 + 2_000) * (1 << 20)
    return browse.resolve_reference(browse.capture_reference(s, m, 11, anchor), s, m).select(*browse.LOCATOR, "session_id", "message_id")


@register("""SELECT s.agent, r.path AS root_path, '/old' || f.path AS path, external_id, s.id AS session_id, m.id AS message_id, CASE WHEN m.id IS NOT NULL THEN m.seq END AS message_index
FROM session s JOIN source_file f ON f.id = s.source_file_id JOIN root r ON r.id = root_id LEFT JOIN message m ON m.session_id = s.id AND m.seq = CASE s.id % 3 WHEN 0 THEN 1 WHEN 1 THEN s.message_count - 1 ELSE 0 END
WHERE s.agent <> 'other' AND f.id % 2 = 0""")
def q15_moved_references(t):
    """References to each session from before its file was moved (every other file): by external uuid, past the last message, before the first."""
    s, m = _summaries(t), t.message().withColumn("external_uuid", F.concat_ws(":", F.lit("u"), "session_id", "seq"))
    kind = F.col("id") % 3
    uuid = F.when(kind == 0, F.concat_ws(":", F.lit("u"), "id", F.lit(1)))
    refs = s.select("agent", "root_path", F.concat(F.lit("/old"), "path").alias("path"), "external_id", F.when(kind == 1, "gone").alias("source_key"), uuid.alias("external_uuid"), F.when(kind == 1, 9_999).when(kind == 2, -5).alias("anchor_index"))
    aliases = t.source_file().where("id % 2 = 0").select("agent", F.col("root_id").alias("prior_root"), F.concat(F.lit("/old"), "path").alias("prior_path"), F.col("id").alias("source_file_id"))
    return browse.resolve_reference(refs, s, m, browse.alias_places(aliases, t.root())).select(*browse.LOCATOR, "session_id", "message_id", "message_index")


@register("SELECT session_id, string_agg('## ' || role || chr(10) || chr(10) || prose, chr(10) || chr(10) ORDER BY seq) AS transcript FROM message WHERE role <> 'system' OR has_error GROUP BY session_id")
def q18_copy_transcript(t):
    m = t.message().withColumn("section_flags", F.lit(None).cast("int"))
    shown = m.where(sections.visible({"prose", "tools"}))
    block = F.struct("seq", F.concat(F.lit("## "), "role", F.lit("\n\n"), "prose").alias("text"))
    return shown.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["text"]), "\n\n").alias("transcript"))


_PAGE = """, hit AS (SELECT id FROM conv_token WHERE starts_with(token, 'th') INTERSECT SELECT id FROM conv_token WHERE token = 'and'),
first_page AS (SELECT m.id, m.session_id, m.ts, p.canonical_key AS project_key FROM message m JOIN session s ON s.id = m.session_id JOIN project p ON p.id = project_id JOIN hit ON hit.id = m.id WHERE m.agent <> 'other' ORDER BY m.ts DESC, m.id DESC LIMIT 200),
ranked AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) - 1 AS rank FROM first_page),
placed AS (SELECT *, min(rank) OVER (PARTITION BY project_key) AS project_at, min(rank) OVER (PARTITION BY project_key, session_id) AS session_at FROM ranked)
SELECT project_at, project_key, session_at, session_id, count(*) AS hits, min(rank) AS first_rank FROM placed GROUP BY ALL"""


@register(_PAGE)
def q19_grouped_results(t):
    page = _found(t, 'th "and"')
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*search.RECENCY())) - 1)  # one page, 200 rows at most
    return search.grouped(ranked).select("project_at", "project_key", "session_at", "session_id", F.size("hits").alias("hits"), F.element_at("hits", 1)["rank"].alias("first_rank"))


@register("--plain SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type")
def q20_latency_report(t):
    return paging.nearest_rank(t.raw("events"), "value", (0.5, 0.95, 0.99), ["event_type"])


BOUNDS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 5000.0)


@register("--plain SELECT strftime(ts, '%Y-%m-%d') AS day, CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def q21_diagnostics(t):
    e = t.raw("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return paging.histogram(e, "value", BOUNDS, ["day"])


@register("--plain SELECT strftime(ts, '%Y-%m-%d') AS day, CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END AS bucket, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY ALL")
def q21_retained_days(t):
    e = t.raw("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return paging.histogram(paging.retained(e, "2024-02-09"), "value", BOUNDS, ["day"])


@register("""--plain SELECT workload, 'value' AS metric, round(median(change), 6) AS change, median(change) > 10 AS regressed
FROM (SELECT workload, pair, (new - base) / base * 100 AS change FROM (SELECT event_type AS workload, event_id % 3 AS pair, median(value) FILTER (user_id % 2 = 0) AS base, median(value) FILTER (user_id % 2 = 1) AS new FROM events GROUP BY ALL)) GROUP BY workload""")
def agg15_paired_change(t):
    e = t.raw("events").select((F.col("event_id") % 3).alias("pair"), F.col("event_type").alias("workload"), F.lit("value").alias("metric"), (F.col("user_id") % 2 == 1).alias("candidate"), "value")
    return paging.paired_change(e).withColumn("change", F.round("change", 6))


@register("""SELECT id, CASE WHEN id % 5 = 0 AND id % 3 <> 2 THEN 'merge' ELSE 'replace' END AS mode, CASE WHEN id % 5 = 0 AND id % 3 <> 2 THEN id ELSE 0 END AS start, '2:7:' || (id + 10) AS revision
FROM source_file WHERE id % 5 <> 1""")
def str15_metadata_work(t):
    """Scans that go on, are done, are of another version or generation, or left no revision that parses."""
    kind = F.col("id") % 5
    last = F.when(kind == 0, F.concat(F.lit("2:7:"), "id")).when(kind == 1, F.concat(F.lit("2:7:"), F.col("id") + 10)).when(kind == 2, F.concat(F.lit("1:7:"), "id")).when(kind == 3, F.concat(F.lit("2:6:"), "id"))
    last = F.when((kind == 4) & (F.col("id") % 2 == 0), "2:7").otherwise(last)
    return dml.metadata_work(t.file_ids().select("id", last.alias("revision"), F.lit(2).alias("version"), F.lit(7).alias("content_generation"), (F.col("id") + 10).alias("scanned_bytes"), (F.col("id") % 3 == 2).alias("snapshot")))


@register("--plain SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), 'äçèéêíñóöü', 'aceeeinoou'), '[\\p{L}\\p{N}]+')) AS token FROM documents) GROUP BY ALL")
def fts1_tokens(t):
    words = t.raw("documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@register("--plain SELECT doc_id, CASE WHEN length(f) > 160 THEN left(f, 159) || '…' ELSE f END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def exp1_preview(t):
    return t.raw("documents").select("doc_id", scalar.preview(F.col("text")).alias("preview"))


@register("SELECT count(*) AS sessions FROM session s WHERE s.agent <> 'other' AND s.project_id = 3")
def agg6_session_count(t):
    summary = t.session().join(F.broadcast(t.supported()), "agent", "left_semi").withColumn("project_key", F.concat(F.lit("/work/proj"), F.col("project_id").cast("string")))
    return browse.session_count(summary, "/work/proj3")


@register("SELECT id, ts FROM message")
def exp9_cursor_times(t):
    return t.message().select("id", scalar.cursor_ts(F.col("id")).alias("ts"))


@register("SELECT project_id, count(*) || CASE WHEN count(*) = 1 THEN ' session' ELSE ' sessions' END AS sessions, '$' || format('{:,}', sum(message_count)::BIGINT) || '.00' AS worth FROM session GROUP BY project_id")
def exp18_labels(t):
    s = t.session().groupBy("project_id").agg(F.count("*").alias("n"), F.sum("message_count").alias("m"))
    return s.select("project_id", scalar.counted(F.col("n"), "session").alias("sessions"), scalar.money(F.col("m")).alias("worth"))


@register("SELECT id, CASE WHEN seq % 3 = 0 THEN prose WHEN prose = '' THEN '' ELSE 'tool ' || prose END AS snippet FROM message")
def prj13_snippets(t):
    """The first section with text that search sees; reasoning is never shown."""
    third = F.col("seq") % 3
    sections_ = {"prose": F.when(third == 0, F.col("prose")), "tool_invocation": F.when((third == 1) & (F.col("prose") != ""), F.concat(F.lit("tool "), "prose")), "tool_output": F.when((third == 2) & (F.col("prose") != ""), F.concat(F.lit("tool "), "prose")), "reasoning": F.lit("thought")}
    return t.message().withColumns(sections_).select("id", sections.snippet().alias("snippet"))


@register("--plain SELECT event_id, epoch_us(ts) // 1000 AS iso_ms, (epoch_us(ts) // 1000000) * 1000 AS seconds_ms, strftime(ts, '%Y-%m-%d') AS day FROM events")
def exp2_timestamps(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return t.raw("events").select("event_id", scalar.timestamp_ms(iso).alias("iso_ms"), scalar.timestamp_ms(F.expr("unix_seconds(cast(ts as timestamp))").cast("string")).alias("seconds_ms"), scalar.day_bucket(ms).alias("day"))


def _sections(t: Tables) -> DataFrame:
    m = t.message()
    by = lambda r, c="prose": F.when(F.col("role") == r, F.col(c)).otherwise("")
    return m.select("id", "role", "has_error", by("user").alias("prose"), by("assistant").alias("tool_invocation"), by("system").alias("tool_output"), F.when(F.col("seq") % 3 == 0, "because").otherwise("").alias("reasoning"), (F.col("seq") % 4 == 0).alias("has_non_text"))


@register("""SELECT id, (CASE WHEN role = 'user' AND prose <> '' THEN 1 ELSE 0 END) + (CASE WHEN role IN ('assistant', 'system') AND prose <> '' THEN 2 ELSE 0 END) + (CASE WHEN seq % 3 = 0 THEN 4 ELSE 0 END) + (CASE WHEN seq % 4 = 0 THEN 8 ELSE 0 END) AS section_flags,
prose AS indexed_text, prose || (CASE WHEN seq % 3 = 0 THEN chr(10) || chr(10) || 'because' ELSE '' END) AS shown_text FROM message""")
def prj8_sections(t):
    return _sections(t).select("id", sections.section_flags().alias("section_flags"), sections.indexed_text().alias("indexed_text"), sections.transcript_text().alias("shown_text"))


@register("SELECT id FROM message WHERE has_error OR (role <> 'system' AND ((role = 'user' AND prose <> '') OR seq % 3 = 0))")
def flt15_visible(t):
    return _sections(t).withColumn("section_flags", sections.section_flags()).where(sections.visible({"prose", "reasoning"})).select("id")


def _as_lines(t: Tables, agent: str, record) -> DataFrame:
    """Messages written as a provider's JSON lines, one file a session."""
    m = t.message()
    return m.select(F.lit(agent).alias("agent"), F.concat(F.lit(f"/logs/{agent}/"), F.col("session_id").cast("string"), F.lit(".jsonl")).alias("path"), (F.col("seq") * 1000).alias("byte_offset"), F.lit(1).cast("bigint").alias("byte_length"), F.to_json(record).alias("raw"))


_PARSED = ("external_id", "source_key", "role", "ts", "prose", "has_error", "is_sidechain")


@register("SELECT 'conv-' || session_id AS external_id, source_key, role, ts, prose, has_error, is_sidechain FROM message WHERE prose <> ''")
def prj1_block_records(t):
    iso = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("prose").alias("text")))
    lines = _as_lines(t, "claude", F.struct(F.col("role").alias("type"), F.col("source_key").alias("uuid"), F.concat(F.lit("conv-"), F.col("session_id").cast("string")).alias("sessionId"), iso.alias("timestamp"), F.col("is_sidechain").alias("isSidechain"), F.col("has_error").alias("is_error"), F.struct(block.alias("content")).alias("message")))
    return adapters.messages(adapters.claude(lines)).select(*_PARSED)


@register("SELECT CAST(session_id AS VARCHAR) AS external_id, 'message:' || source_key AS source_key, role, ts, prose FROM message WHERE prose <> ''")
def prj4_rollout_records(t):
    payload = F.struct(F.lit("message").alias("type"), F.col("source_key").alias("id"), F.col("role").alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), F.col("prose").alias("text"))).alias("content"))
    lines = _as_lines(t, "codex", F.struct(F.lit("response_item").alias("type"), F.col("ts").alias("timestamp"), payload.alias("payload")))
    return adapters.messages(adapters.codex(lines)).select("external_id", "source_key", "role", "ts", "prose")


@register("SELECT CAST(session_id AS VARCHAR) AS external_id, source_key, role, ts, prose FROM message WHERE prose <> ''")
def prj6_chat_records(t):
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role") == "system", "info").otherwise("user")
    lines = _as_lines(t, "gemini", F.struct(F.col("session_id").cast("string").alias("sessionId"), F.array(F.struct(F.col("source_key").alias("id"), kind.alias("type"), F.col("ts").alias("timestamp"), F.col("prose").alias("content"))).alias("messages")))
    return adapters.messages(adapters.gemini(lines)).select("external_id", "source_key", "role", "ts", "prose")


def _log_lines(t: Tables) -> DataFrame:
    """Conversations as log files of one provider: ten sessions a file, records in order, usage on every third."""
    iso = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    used = F.when(F.col("seq") % 3 == 0, F.struct((F.col("seq") + 1).alias("input_tokens"), F.length("prose").alias("output_tokens")))
    body = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("prose").alias("text"))).alias("content"), F.when(F.col("seq") % 3 == 0, "mod").alias("model"), used.alias("usage"))
    record = F.struct(F.col("role").alias("type"), F.col("source_key").alias("uuid"), F.concat(F.lit("conv-"), F.col("session_id").cast("string")).alias("sessionId"), F.concat(F.lit("/work/proj"), F.pmod("source_file_id", F.lit(7)).cast("string")).alias("cwd"), iso.alias("timestamp"), F.col("has_error").alias("is_error"), body.alias("message"))
    path = F.concat(F.lit("/logs/claude/f"), F.col("source_file_id").cast("string"), F.lit(".jsonl"))
    return t.message().select(F.lit("claude").alias("agent"), path.alias("path"), (F.col("session_id") * 1_000_000 + F.col("seq") * 1000).alias("byte_offset"), F.lit(1).cast("bigint").alias("byte_length"), F.to_json(record).alias("raw"), "seq")


def _log_files(lines: DataFrame, action: str, stored: DataFrame | None = None) -> DataFrame:
    files = lines.groupBy("agent", "path").agg(F.max("byte_offset").alias("size")).select("agent", "path", F.lit(1).cast("bigint").alias("root_id"), F.lit(1).cast("bigint").alias("dev"), F.xxhash64("path").alias("inode"), "size", F.lit(1).cast("bigint").alias("mtime_ns"), F.lit("h").alias("head_hash"), F.lit(1).alias("head_length"), F.lit(action).alias("action"), F.lit(0).cast("bigint").alias("start"))
    return index_job.with_ids(files, stored if stored is not None else _no_files(lines), "agent", "path")


def _no_files(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], index_job.FILE)


def _indexed(t: Tables, halves: bool = False) -> dict[str, DataFrame]:
    """The job's tables from those logs: read at once, or the first turns and then what came after."""
    lines = storage.save(_log_lines(t), "lines")
    empty = {n: t.spark.createDataFrame([], s) for n, s in index_job.TABLES.items()}
    if not halves:
        return index_job.build(empty, _log_files(lines, "new"), lines.drop("seq"))
    early, late = lines.where("seq < 3"), lines.where("seq >= 3")
    first = {n: storage.save(df, n) for n, df in index_job.build(empty, _log_files(early, "new"), early.drop("seq")).items()}
    return index_job.build(first, _log_files(late, "append", first["source_file"]), late.drop("seq"))


_LOGGED = """, said AS (SELECT session_id, source_file_id, 'conv-' || session_id AS external_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS place, source_key, role, ts, prose, f, has_error, seq, id FROM flat WHERE prose <> '')"""


@register(_LOGGED + " SELECT external_id, place AS seq, source_key, role, ts, prose, has_error, id, CASE WHEN length(f) > 160 THEN left(f, 159) || '…' ELSE f END AS prefix, 1 AS section_flags, '/logs/claude/f' || source_file_id || '.jsonl' AS path FROM said")
def q17_index_messages(t):
    out = _indexed(t)
    s, f = out["session"].select(F.col("id").alias("session_id"), "external_id"), out["source_file"].select(F.col("id").alias("source_file_id"), "path")
    return out["message"].join(s, "session_id").join(f, "source_file_id").select("external_id", "seq", "source_key", "role", "ts", "prose", "has_error", "id", "prefix", "section_flags", "path")


_INDEXED_SESSIONS = _LOGGED + """ SELECT external_id, '/work/proj' || source_file_id % 7 AS project_key, min(ts) AS started_at, max(ts) AS last_activity_at, count(*) AS message_count, bool_or(has_error) AS had_error,
  arg_min(CASE WHEN length(f) > 160 THEN left(f, 159) || '…' ELSE f END, place) FILTER (role = 'user') AS title FROM said GROUP BY external_id, source_file_id"""


def _session_rows(out: dict[str, DataFrame]) -> DataFrame:
    p = out["project"].select(F.col("id").alias("project_id"), F.col("canonical_key").alias("project_key"))
    return out["session"].join(p, "project_id").select("external_id", "project_key", "started_at", "last_activity_at", "message_count", "had_error", "title")


@register(_INDEXED_SESSIONS)
def q17_index_sessions(t):
    return _session_rows(_indexed(t))


@register(_INDEXED_SESSIONS)
def q17_appended_sessions(t):
    """Files that grew between two runs give what one run over the whole gives."""
    return _session_rows(_indexed(t, halves=True))


@register("SELECT strftime(make_timestamp((ts // 1000) * 1000000), '%Y-%m-%d') AS day, '/work/proj' || source_file_id % 7 AS project_key, sum(seq + 1)::BIGINT AS input_tokens, sum(length(prose))::BIGINT AS output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id, source_key ORDER BY session_id) AS n FROM message WHERE seq % 3 = 0 QUALIFY n = 1) GROUP BY ALL")
def q17_index_usage(t):
    out = _indexed(t)
    p = out["project"].select(F.col("id").alias("project_id"), F.col("canonical_key").alias("project_key"))
    return usage.daily(out["observation"].withColumn("dedupe_key", F.concat_ws(":", "source_file_id", "dedupe_key"))).join(p, "project_id").groupBy("day", "project_key").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@register("""SELECT strftime(make_timestamp((c.ts // 1000) * 1000000), '%Y-%m-%d') AS day, coalesce(c.project_id, s.project_id) AS project_id, c.model, c.is_sidechain, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens
  FROM (SELECT * EXCLUDE (project_id), CASE WHEN id % 4 <> 1 THEN project_id END AS project_id FROM
    (SELECT agent, dedupe_key, id, user_id, row_number() OVER (PARTITION BY agent, dedupe_key ORDER BY coalesce(output_tokens, -1) DESC, id DESC) AS rn, ts, project_id, model, is_sidechain, max(input_tokens) OVER w AS input_tokens, max(output_tokens) OVER w AS output_tokens
     FROM observation JOIN (SELECT event_id, user_id FROM events) e ON e.event_id = id WINDOW w AS (PARTITION BY agent, dedupe_key)) WHERE rn = 1) c
  JOIN session s ON s.id = c.user_id GROUP BY ALL""")
def q9_usage_of_sessions(t):
    """Observations that name no project count for their session's; those of sessions that are no more do not count."""
    seen = t.observations().withColumn("project_id", F.when(F.col("id") % 4 != 1, F.col("project_id")))
    return usage.daily(seen, t.session()).select("day", "project_id", "model", "is_sidechain", "input_tokens", "output_tokens")


def _stand(t: Tables, lines: DataFrame, folder: str, cut: int = 0) -> DataFrame:
    """The logs as files of one folder, as discovery finds them; written in tasks, a file at a time, without its last ``cut`` bytes."""

    def write(rows):
        import os

        import pandas as pd

        agent, path = rows["agent"].iloc[0], folder + rows["path"].iloc[0]
        os.makedirs(os.path.dirname(path), exist_ok=True)
        data = "".join(r + "\n" for r in rows.sort_values("byte_offset")["raw"]).encode()
        with open(path, "wb") as f:
            f.write(data[: len(data) - cut])
        return pd.DataFrame({"agent": [agent], "path": [path]})

    written = storage.save(lines.select("agent", "path", "byte_offset", "raw").groupBy("agent", "path").applyInPandas(write, "agent string, path string"), "logs")
    return storage.save(look_again(written).drop("error").withColumn("root_id", F.lit(1).cast("bigint")), "found")


def _folder(t: Tables, tag: str) -> str:
    return re.sub("^file:/*", "/", storage.new_folder(t.spark, tag))


def _stored_messages(store: index_job.Store) -> DataFrame:
    out = store.tables()
    return out["message"].join(out["session"].select(F.col("id").alias("session_id"), "external_id"), "session_id")


@register(_LOGGED + " SELECT external_id, place AS seq, source_key, role, ts, prose, has_error, id, CASE WHEN length(f) > 160 THEN left(f, 159) || '…' ELSE f END AS prefix FROM said")
def q17_increment_messages(t):
    """Log files on disk that grow between two runs over a store in buckets."""
    # What comes later stands behind all that came first, as in any log.
    lines = storage.save(_log_lines(t).withColumn("byte_offset", F.col("byte_offset") + F.when(F.col("seq") < 3, 0).otherwise(1 << 50)), "lines")
    folder = _folder(t, "logs")
    store = index_job.Store(t.spark, storage.new_folder(t.spark, "store"), buckets=16)
    index_job.refresh(store, _stand(t, lines.where("seq < 3"), folder))
    index_job.refresh(store, _stand(t, lines, folder))
    return _stored_messages(store).select("external_id", "seq", "source_key", "role", "ts", "prose", "has_error", "id", "prefix")


@register(_LOGGED + " SELECT external_id, source_key, prose, true AS hydrated FROM said")
def q16_hydrated_messages(t):
    """Messages stored without their text, read again from their own bytes of the log files."""
    store = index_job.Store(t.spark, storage.new_folder(t.spark, "store"), buckets=16)
    index_job.refresh(store, _stand(t, _log_lines(t), _folder(t, "logs")))
    emptied = _stored_messages(store).withColumn("prose", F.lit(""))
    return index_job.hydrate(emptied, store.tables()["source_file"]).select("external_id", "source_key", "prose", "hydrated")


def _chat_documents(t: Tables, tag: str) -> DataFrame:
    """Sessions as one snapshot file each; ``tag`` stands before each text."""
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role") == "system", "info").otherwise("user")
    said = F.struct("seq", F.col("source_key").alias("id"), kind.alias("type"), F.col("ts").alias("timestamp"), F.concat(F.lit(tag), "prose").alias("content"))
    docs = t.message().groupBy("session_id").agg(F.sort_array(F.collect_list(said)).alias("messages"))  # the turns of one conversation are one file
    raw = F.to_json(F.struct(F.col("session_id").cast("string").alias("sessionId"), "messages"))
    return docs.select(F.lit("gemini").alias("agent"), F.concat(F.lit("/p/chats/session-"), F.col("session_id").cast("string"), F.lit(".json")).alias("path"), F.lit(0).cast("bigint").alias("byte_offset"), raw.alias("raw"))


@register("SELECT CAST(session_id AS VARCHAR) AS external_id, source_key, CASE WHEN session_id % 3 = 0 THEN 'new ' ELSE 'old ' END || prose AS prose, session_id % 3 = 1 AS failed FROM message")
def q17_kept_snapshots(t):
    """Snapshots written anew: whole ones replace their messages, those that break off keep what is stored and are reported."""
    folder = _folder(t, "chats")
    store = index_job.Store(t.spark, storage.new_folder(t.spark, "store"), buckets=16)
    first, second = (storage.save(_chat_documents(t, tag), "chats") for tag in ("old ", "new "))
    number = F.regexp_extract("path", r"session-(\d+)", 1).cast("bigint") % 3
    index_job.refresh(store, _stand(t, first, folder))
    _stand(t, second.where(number == 0), folder)
    _stand(t, second.where(number == 1), folder, cut=9)
    index_job.refresh(store, look_again(first.select("agent", F.concat(F.lit(folder), "path").alias("path"))).drop("error").withColumn("root_id", F.lit(1).cast("bigint")))
    files = store.tables()["source_file"].select(F.col("id").alias("source_file_id"), F.col("last_error").isNotNull().alias("failed"))
    return _stored_messages(store).join(files, "source_file_id").select("external_id", "source_key", "prose", "failed")


@register("SELECT source_file_id, session_id, seq, last_value(CASE WHEN seq % 3 = 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY source_file_id ORDER BY session_id, seq) AS ts FROM message")
def win5_carried_timestamps(t):
    rows = t.message().select("source_file_id", "session_id", "seq", F.when(F.col("seq") % 3 == 0, F.col("ts")).alias("ts"))
    return ingest.carry(rows, "ts", by=("source_file_id",), order=("session_id", "seq"), slices=F.floor(F.col("session_id") / 16))


@register("SELECT session_id, seq, (ts // 10000 * 10000) * 1048576 + row_number() OVER (PARTITION BY ts // 10000 ORDER BY session_id, seq) - 1 AS id FROM message")
def win4_message_ids(t):
    rows = t.message().select("session_id", "seq", (F.floor(F.col("ts") / 10_000) * 10_000).alias("ts"))
    return ingest.message_ids(rows, ("session_id", "seq")).select("session_id", "seq", "id")


@register("SELECT source_file_id, external_id, started_at, last_activity_at, message_count, first_user_message AS title, had_error FROM session")
def agg7_session_fold(t):
    rows = t.message().withColumn("external_id", F.concat(F.lit("conv-"), F.col("session_id").cast("string"))).withColumn("project_key", F.lit("p"))
    return ingest.fold_sessions(rows).select("source_file_id", "external_id", "started_at", "last_activity_at", "message_count", "title", "had_error")


@register("SELECT source_file_id, external_id, started_at, last_activity_at, message_count, first_user_message AS title, had_error FROM session")
def snk3_merged_sessions(t):
    """Folding two halves and merging them is folding the whole."""
    rows = t.message().withColumn("external_id", F.concat(F.lit("conv-"), F.col("session_id").cast("string"))).withColumn("project_key", F.lit("p"))
    halves = [ingest.fold_sessions(rows.where(c)) for c in ("seq < 3", "seq >= 3")]
    return ingest.merge_sessions(*halves).select("source_file_id", "external_id", "started_at", "last_activity_at", "message_count", "title", "had_error")


@register("SELECT id, path, arg_max(root, length(root)) AS root FROM source_file, (VALUES ('/logs'), ('/logs/claude'), ('/logs/codex')) r(root) WHERE starts_with(path, root || '/') GROUP BY id, path")
def jn15_owner_root(t):
    files = t.source_file().select("id", "path", F.lit("any").alias("agent"))
    roots = t.spark.createDataFrame([("any", p, i) for i, p in enumerate(("/logs", "/logs/claude", "/logs/codex"))], "agent string, path string, id int")
    owner = dml.owner_root(files, roots).join(roots.select(F.col("id").alias("root_id"), F.col("path").alias("root")), "root_id")
    return files.select("id", "path").join(owner.select("path", "root"), "path")


@register("SELECT id, session_id, seq FROM message WHERE source_file_id % 3 <> 0 UNION ALL SELECT id, session_id, seq FROM message WHERE source_file_id % 3 = 0 AND seq = 0")
def snk6_replaced_files(t):
    m = t.message().select("id", "source_file_id", "session_id", "seq")
    again = m.where("source_file_id % 3 = 0")
    return dml.replace_files(m, again.where("seq = 0"), again.select("source_file_id")).select("id", "session_id", "seq")


@register("SELECT DISTINCT p.id, display_name FROM project p JOIN session s ON s.project_id = p.id WHERE s.source_file_id % 2 = 1")
def snk8_deleted_files(t):
    tables = {"session": t.session(), "project": t.project(), "source_file": t.source_file()}
    gone = t.source_file().where("id % 2 = 0").select(F.col("id").alias("source_file_id"))
    return dml.delete_files(tables, gone)["project"].select("id", "display_name")


@register("SELECT agent, path FROM source_file WHERE id % 3 = 0 AND agent <> 'codex'")
def str13_reconciled(t):
    stored = t.source_file().select("agent", "path", "id")
    scanned = t.root().select("agent", F.col("path").alias("scope"), (F.col("agent") == "codex").alias("failed"))
    return dml.reconcile(stored, stored.where("id % 3 <> 0"), scanned).select("agent", "path")


@register("SELECT id FROM session s WHERE id IN (SELECT session_id FROM message WHERE has_error AND seq % 2 = 1)")
def flt22_unaccounted_errors(t):
    return browse.legacy_failures(t.session(), t.message(), t.failure()).select("id")


@register("SELECT id, source_key FROM observation2 WHERE n = 1 AND source_file_id % 2 = 1".replace("observation2", "(SELECT event_id AS id, event_id // 3 AS k, CAST(event_id // 3 AS VARCHAR) AS source_key, user_id % 50 AS source_file_id, row_number() OVER (PARTITION BY user_id % 50, event_id // 3 ORDER BY event_id) AS n FROM events)"))
def snk4_new_observations(t):
    fresh = t.observations().withColumn("source_key", F.expr("cast(id div 3 as string)"))
    return usage.insert_or_ignore(fresh.where("source_file_id % 2 = 0"), fresh).select("id", "source_key")


@register("SELECT session_id, source_key, CASE WHEN seq % 4 = 0 THEN 'again' ELSE CASE WHEN length(f) > 40 THEN left(f, 39) || '…' ELSE f END END AS detail FROM flat WHERE has_error AND seq % 2 = 0")
def snk5_failures_replaced(t):
    stored = t.failure().select("session_id", "source_key", "detail")
    again = t.message().where("has_error and seq % 4 = 0").select("session_id", "source_key", F.explode(F.array(F.lit("first"), F.lit("again"))).alias("detail"))
    fresh = again.withColumn("arrival", F.when(F.col("detail") == "again", 2).otherwise(1))
    return dml.upsert_failures(stored, fresh)


@register("SELECT f.id, f.path FROM source_file f WHERE f.agent IN ('claude', 'gemini')")
def snk12_synchronised_roots(t):
    configured = t.root().where(F.col("agent").isin("claude", "gemini"))
    kept, _, _ = dml.synchronise_roots(t.root(), configured)
    return t.source_file().join(kept.select(F.col("id").alias("root_id")), "root_id", "left_semi").select("id", "path")


@register("SELECT root_id, relative_scope, error FROM scan_error WHERE root_id <> 1 UNION ALL SELECT 1, 'fresh', 'gone'")
def snk15_scan_errors_replaced(t):
    stored = t.scan_error().select("root_id", "relative_scope", "error")
    fresh = t.spark.createDataFrame([(1, "fresh", "gone")], "root_id bigint, relative_scope string, error string")
    return dml.replace_scan_errors(stored, t.spark.createDataFrame([(1, "")], "root_id bigint, relative_scope string"), fresh)


@register("SELECT external_id, CASE WHEN id % 2 = 0 THEN coalesce(first_user_message, 'other') ELSE first_user_message END AS first_user_message, CASE WHEN id % 2 = 0 THEN 'scan ' || id END AS generated_title, id % 6 = 0 AS has_plan FROM session")
def snk16_merged_metadata(t):
    s = t.session().withColumn("has_plan", F.lit(None).cast("boolean"))
    scan = s.where("id % 2 = 0").select("external_id", F.lit("other").alias("first_user_message"), F.concat(F.lit("scan "), F.col("id").cast("string")).alias("generated_title"), (F.col("id") % 3 == 0).alias("has_plan"))
    return dml.merge_metadata(s, scan).select("external_id", "first_user_message", "generated_title", "has_plan")


@register("SELECT external_id, CASE WHEN id % 3 = 0 THEN 'side ' || id WHEN id % 2 = 0 THEN NULL ELSE 'own' END AS generated_title FROM session")
def snk17_side_file_titles(t):
    s = t.session().withColumn("generated_title", F.when(F.col("id") % 2 == 0, "earlier").when(F.col("id") % 3 != 0, "own")).withColumn("title_origin", F.when(F.col("id") % 2 == 0, "index"))
    names = s.where("id % 3 = 0").select("external_id", F.concat(F.lit("side "), F.col("id").cast("string")).alias("name"), F.lit("index").alias("origin"))
    return dml.apply_titles(s, names).select("external_id", "generated_title")


@register("SELECT id, 'Proj' || id AS display_name FROM project WHERE lower('Proj' || id) LIKE '%oj1%'")
def flt14_projects_by_name(t):
    return browse.name_contains(t.project(), " OJ1 ").select("id", "display_name")


@register("--plain SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'ask ' || user_id END AS title, user_id % 2 = 0 AS has_plan FROM (SELECT DISTINCT user_id FROM events)")
def flt19_typed_titles(t):
    u = t.raw("events").select("user_id").distinct()
    ask = F.concat(F.lit("ask "), F.col("user_id").cast("string"))
    text = F.when(F.col("user_id") % 3 == 0, F.lit("# AGENTS.md instructions for x")).otherwise(F.concat(F.lit("<system-reminder>no</system-reminder>  "), ask))
    plan = F.when(F.col("user_id") % 2 == 0, F.lit("a <proposed_plan> go </proposed_plan>")).otherwise(F.lit("<proposed_plan> </proposed_plan>"))
    return u.select("user_id", sections.user_title(text).alias("title"), sections.has_plan(plan).alias("has_plan"))


@register("SELECT 'conv-' || session_id AS external_id, arg_min(CASE WHEN length(f) > 160 THEN left(f, 159) || '…' ELSE f END, seq) FILTER (role = 'user' AND f <> '') AS first_user_message, arg_max('title ' || seq, seq) FILTER (seq % 3 = 1) AS generated_title, bool_or(seq = 4) AS has_plan FROM flat GROUP BY session_id")
def agg16_session_metadata(t):
    m = t.message().withColumn("path", F.col("source_file_id").cast("string")).withColumn("byte_offset", F.col("seq")).withColumn("item", F.lit(0)).withColumn("external_id", F.concat(F.lit("conv-"), F.col("session_id").cast("string")))
    rows = m.withColumn("prose", F.when(F.col("role") == "user", F.col("prose"))).withColumn("explicit_title", F.when(F.col("seq") % 3 == 1, F.concat(F.lit("title "), F.col("seq").cast("string"))).when(F.col("seq") % 3 == 2, F.lit("  "))).withColumn("plan", F.col("seq") == 4)
    return ingest.session_metadata(rows)


@register("--plain SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 'bad ' || event_id ELSE NULL END AS error FROM events")
def exp3_json_values(t):
    e = t.raw("events")
    v = F.parse_json("props")
    failure = F.parse_json(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"error":{"message":" bad '), F.col("event_id").cast("string"), F.lit(' "}}'))).otherwise(F.lit('{"error":{"code":5}}')))
    return e.select("event_id", scalar.lenient_long(v, "$.k").alias("k"), scalar.error_description(failure).alias("error"))


@register("SELECT DISTINCT model, model_pattern FROM rated WHERE best = 1")
def jn14_models_with_rates(t):
    models = t.observations().select("model").distinct()
    return usage.with_rates(models, t.rates()).select("model", F.col("rate.model_pattern").alias("model_pattern"))


@register("SELECT DISTINCT '/logs/' || agent AS path FROM source_file")
def set4_minimal_scopes(t):
    scopes = t.source_file().select("path").union(t.source_file().select(F.concat(F.lit("/logs/"), "agent").alias("path")))
    return dml.minimal_cover(scopes)


@register("SELECT id, CASE WHEN id % 5 = 0 THEN 'new' WHEN id % 5 = 1 THEN 'skip' WHEN id % 5 = 2 THEN 'append' ELSE 'replace' END AS action FROM source_file")
def flt18_file_actions(t):
    base = t.source_file().select("id", "agent", "path", F.lit(1).alias("dev"), F.col("id").alias("inode"))
    stored = base.where("id % 5 <> 0").select("*", F.lit(10).alias("size"), F.lit(5).alias("mtime_ns"), F.lit("h").alias("head_hash"), F.lit(10).alias("scanned_bytes"), F.lit(None).cast("string").alias("last_error"))
    found = base.withColumn("file", F.col("id")).drop("id").withColumn("size", F.when(F.col("file") % 5 == 2, 20).when(F.col("file") % 5 == 3, 4).otherwise(10)).withColumn("mtime_ns", F.when((F.col("file") % 5).isin(2, 3), 6).otherwise(5)).withColumn("head_hash", F.when(F.col("file") % 5 == 4, "x").otherwise("h"))
    return dml.changed_files(found, stored).select(F.col("file").alias("id"), "action")


@register("SELECT id, row_number() OVER (ORDER BY last_activity_at DESC, id DESC) <= 10 AS recent FROM session ORDER BY last_activity_at DESC, id DESC LIMIT 10")
def ord6_recent_sessions(t):
    return paging.page(t.session(), paging.SESSION_KEYS, paging.RECENT).select("id", F.lit(True).alias("recent"))


@register("--plain SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def ext_event_windows(t):
    out = tail.windowed_counts(t.raw("events"))
    return out.select("start", "event_type", "n", F.round("value", 4).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
