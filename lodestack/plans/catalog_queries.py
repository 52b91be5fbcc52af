"""Catalogue, session, feedback, mutation and report queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import mutations as M
from ..sources.tables import table
from . import views as V


def _plain(docs):
    return docs.select("doc_id", "user_id", "title", "source_type")


def list_docs(s, d):
    return C.list_documents(_plain(V.documents(s, d)), V.chunks(s, d))


def filed_docs(s, d):
    return C.filed_documents(V.documents(s, d).select("doc_id", "title"), V.assignments(s, d), V.chunks(s, d))


def stats_by_type(s, d):
    docs = V.documents(s, d).withColumn("source_type", F.col("lang"))
    return C.stats_by_type(docs.select("doc_id", "source_type"), V.chunks(s, d))


def top_docs(s, d):
    return C.top_documents(V.documents(s, d).select("doc_id"), V.chunks(s, d))


def unfiled_anti(s, d):
    return C.unfiled(V.documents(s, d).select(F.lit("u").alias("user_id"), "doc_id"), V.assignments(s, d)).select("doc_id")


def live_exists(s, d):
    return C.live_documents(V.documents(s, d).select("doc_id"), V.chunks(s, d).filter("chunk_index > 1 and doc_id % 3 = 0"))


def doc_labels(s, d):
    meta = V.documents(s, d).filter("doc_id % 2 = 0").select("doc_id", F.substring("text", 1, 20).alias("summary"))
    return C.summaries(V.documents(s, d).select("doc_id", "title"), meta)


def doc_preview(s, d):
    return C.concat_text(V.chunks(s, d), first=3, longest=800)


def memory_concat(s, d):
    return C.concat_text(V.chunks(s, d)).select("doc_id", F.sha2("text", 256).alias("sha"))


def session_list(s, d):
    return C.sessions(V.messages(s, d))


def preceding_user_turn(s, d):
    return C.preceding_question(V.messages(s, d)).filter("role = 'assistant'").select("message_id", "question")


def feedback_export(s, d):
    return C.rated_turns(V.messages(s, d), V.feedback(s, d))


def feedback_summary(s, d):
    return C.feedback_summary(V.feedback(s, d))


def latest_negatives(s, d):
    return C.latest_negative(V.messages(s, d), V.feedback(s, d))


def session_tokens(s, d):
    return C.session_tokens(V.messages(s, d), 60)


def feedback_ema(s, d):
    return C.feedback_ema(table(s, d, "events"))


def latency(s, d):
    return C.latency(table(s, d, "events"))


def latest_event(s, d):
    return C.latest_per_key(table(s, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")


def recent_messages(s, d):
    return C.recent_messages(table(s, d, "conversations"))


def _log(s, d):
    return table(s, d, "events").select((F.col("event_id") % 300).alias("job_id"), F.col("event_id").alias("at"), F.element_at(F.array(*[F.lit(x) for x in ("running", "queued", "done", "failed", "running")]), (F.col("user_id") % 5 + 1).cast("int")).alias("status"), (F.col("event_id") % 7).alias("progress"))


def job_list(s, d):
    return C.jobs(_log(s, d))


def job_states(s, d):
    return M.job_states(_log(s, d))


def upsert_customers(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(1.0)).unionByName(c.filter("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000).withColumn("c_acctbal", F.lit(2.0)))
    return M.upsert(c, new.unionByName(new.withColumn("c_acctbal", F.lit(0.5))), "c_custkey")


def delete_sessions(s, d):
    gone = V.messages(s, d).filter("session_id % 4 = 1").select("session_id")
    return M.delete(V.messages(s, d), gone, "session_id").select("message_id")


def tombstones(s, d):
    return M.tombstone(V.chunks(s, d), V.documents(s, d).filter("doc_id % 4 = 0")).groupBy("doc_id").agg(F.count_if("excluded").alias("n"))


def rate_messages(s, d):
    new = V.messages(s, d).filter("message_id % 2 = 0").select(F.col("message_id").cast("string").alias("message_id"), F.when(F.col("message_id") % 3 == 0, 1).when(F.col("message_id") % 3 == 1, 5).otherwise(-1).alias("rating"))
    return M.rate(V.feedback(s, d), new, V.messages(s, d))


QUERIES = {f.__name__: f for f in (list_docs, filed_docs, stats_by_type, top_docs, unfiled_anti, live_exists, doc_labels, doc_preview, memory_concat, session_list, preceding_user_turn, feedback_export, feedback_summary, latest_negatives,
                                   session_tokens, feedback_ema, latency, latest_event, recent_messages, job_list, job_states, upsert_customers, delete_sessions, tombstones, rate_messages)}

_N = "n AS (SELECT doc_id, count(*) AS n_chunks FROM chunks WHERE NOT excluded GROUP BY doc_id)"
_ASKED = "asked AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM messages)"
_RATED = "SELECT a.message_id, a.session_id, f.rating, a.question, a.content AS answer FROM asked a JOIN feedback f ON CAST(f.message_id AS BIGINT) = a.message_id WHERE f.rating <> 0"
_LOG = "log AS (SELECT event_id % 300 AS job_id, event_id AS \"at\", ['running', 'queued', 'done', 'failed', 'running'][user_id % 5 + 1] AS status, event_id % 7 AS progress FROM events)"

ORACLES = {
    "list_docs": f"WITH {V.CHUNKS}, {_N} SELECT doc_id, source AS user_id, concat(source, '-', doc_id) AS title, 'document' AS source_type, coalesce(n_chunks, 0) AS n_chunks FROM documents LEFT JOIN n USING (doc_id)",
    "filed_docs": f"WITH {V.CHUNKS}, {_N}, {V.ASSIGNMENTS} SELECT doc_id, concat(source, '-', doc_id) AS title, coalesce(n_chunks, 0) AS n_chunks, node_id, CASE WHEN node_id IS NOT NULL THEN true END AS is_primary FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN filed USING (doc_id)",
    "stats_by_type": f"WITH {V.CHUNKS}, p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT excluded) AS live FROM chunks GROUP BY doc_id) SELECT lang AS source_type, count(*) AS n_documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(live), 0) AS BIGINT) AS n_live FROM documents LEFT JOIN p USING (doc_id) GROUP BY ROLLUP (lang)",
    "top_docs": f"WITH {V.CHUNKS}, {_N} SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks FROM documents LEFT JOIN n USING (doc_id) ORDER BY n_chunks DESC, doc_id LIMIT 10",
    "unfiled_anti": f"WITH {V.ASSIGNMENTS} SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM filed WHERE filed.doc_id = d.doc_id)",
    "live_exists": f"WITH {V.CHUNKS} SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = d.doc_id AND NOT excluded AND chunk_index > 1 AND doc_id % 3 = 0)",
    "doc_labels": "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 20) END, concat(source, '-', doc_id)) AS label FROM documents",
    "doc_preview": f"WITH {V.CHUNKS} SELECT doc_id, substring(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index), 1, 800) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS r FROM chunks WHERE NOT excluded) WHERE r <= 3 GROUP BY doc_id",
    "memory_concat": f"WITH {V.CHUNKS} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS sha FROM chunks WHERE NOT excluded GROUP BY doc_id",
    "session_list": f"WITH {V.MESSAGES}, g AS (SELECT session_id, count(*) AS n_messages, arg_min(content, message_id) FILTER (role = 'user') AS said, max(message_id) AS last FROM messages GROUP BY session_id) SELECT session_id, n_messages, CASE WHEN length(said) > 60 THEN concat(substring(said, 1, 60), '…') ELSE coalesce(said, '') END AS title FROM g ORDER BY last DESC, session_id LIMIT 200",
    "preceding_user_turn": f"WITH {V.MESSAGES}, {_ASKED} SELECT message_id, question FROM asked WHERE role = 'assistant'",
    "feedback_export": f"WITH {V.MESSAGES}, {V.FEEDBACK}, {_ASKED} {_RATED}",
    "feedback_summary": f"WITH {V.FEEDBACK} SELECT count(*) FILTER (rating = 1) AS up, count(*) FILTER (rating = -1) AS down, count(*) FILTER (rating <> 0) AS total, count(DISTINCT CASE WHEN rating <> 0 THEN session_id END) AS n_sessions FROM feedback",
    "latest_negatives": f"WITH {V.MESSAGES}, {V.FEEDBACK}, {_ASKED} SELECT * FROM ({_RATED}) WHERE rating = -1 ORDER BY message_id DESC LIMIT 5",
    "session_tokens": f"WITH {V.MESSAGES} SELECT session_id, CAST(sum(greatest(1, length(content) // 4)) AS BIGINT) AS tokens, sum(greatest(1, length(content) // 4)) > 60 AS over FROM messages GROUP BY session_id",
    "feedback_ema": """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 WHEN event_type = 'error' THEN -1e0 END AS s FROM events),
n AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE s IS NOT NULL)
SELECT user_id, round(sum(s * pow(7e-1, n - i) * CASE WHEN i = 1 THEN 1e0 ELSE 3e-1 END), 6) AS ema, count(*) AS n_signals FROM n GROUP BY user_id""",
    "latency": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type",
    "latest_event": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "recent_messages": """WITH w AS (SELECT *, row_number() OVER o - CAST(coalesce(first_value(role) OVER o = 'user', false) AS INTEGER) AS back FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC))
SELECT conv_id, turn, role, text, CAST(back AS INTEGER) AS back FROM w WHERE back BETWEEN 1 AND 6""",
    "job_list": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY \"at\" DESC, progress DESC) AS r FROM log) SELECT job_id, \"at\", status, progress FROM r WHERE r = 1 ORDER BY \"at\" DESC, job_id LIMIT 50",
    "job_states": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY status IN ('done', 'failed') DESC, CASE WHEN status IN ('done', 'failed') THEN \"at\" ELSE -\"at\" END) AS r FROM log) SELECT job_id, status, progress, \"at\" FROM r WHERE r = 1",
    "upsert_customers": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 1e0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, 2e0 FROM customer WHERE c_custkey % 10 = 0",
    "delete_sessions": f"WITH {V.MESSAGES} SELECT message_id FROM messages WHERE session_id % 4 <> 1",
    "tombstones": f"WITH {V.CHUNKS} SELECT doc_id, count(*) FILTER (excluded OR doc_id % 4 = 0) AS n FROM chunks GROUP BY doc_id",
    "rate_messages": f"""WITH {V.MESSAGES}, {V.FEEDBACK}, k AS (SELECT CAST(message_id AS VARCHAR) AS message_id, session_id, CASE message_id % 3 WHEN 0 THEN 1 ELSE -1 END AS rating FROM messages WHERE message_id % 2 = 0 AND message_id % 3 <> 1)
SELECT message_id, session_id, rating FROM feedback WHERE message_id NOT IN (SELECT message_id FROM k) UNION ALL SELECT message_id, session_id, rating FROM k""",
}
