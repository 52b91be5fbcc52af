"""Policy, fallback, doubt and document map queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import graph as G
from ..operators import planning as L
from ..operators import retrieval as R
from ..operators import turn
from ..operators.catalog import feedback_ema
from ..sources.tables import table, written
from . import retrieval_queries as RQ
from . import text_queries as TQ
from . import views as V


def _asked(s, d):
    return V.vector_queries(s, d).select("query_id", F.element_at(F.array(*[F.lit(x) for x in ("greeting", "personal", "factual", "general", "unclear", "odd")]), (F.col("query_id") % 6 + 1).cast("int")).alias("intent"))


def adaptive_topk(s, d):
    return L.plan(_asked(s, d)).select("query_id", "intent", "scope", F.array_join("source_types", ",").alias("source_types"), "final_k", "vector_k")


def math_filter_retry(s, d):
    v, q = V.vectors(s, d), V.vector_queries(s, d)
    some = R.cosine_neighbours(v.filter("label = 3"), q.filter("query_id % 40 = 0"), 3).withColumnRenamed("vec_id", "doc_id")
    return L.filtered_or_all(some, R.cosine_neighbours(v, q, 2).withColumnRenamed("vec_id", "doc_id"))


def general_swap(s, d):
    ranked = R.cosine_neighbours(V.vectors(s, d).filter("label = 9 and vec_id % 20 <> 0"), V.vector_queries(s, d), 1)
    return L.swap_to_general(_asked(s, d).withColumn("intent", F.when(F.col("intent") == "odd", "factual").otherwise(F.col("intent"))), ranked, 0.25)


def _answers(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("answer_id"), F.concat(F.substring("text", 1, 60), F.lit("[UNCERTAIN] and. So it is! Or is it? maybe[UNCERTAIN]\n"), F.substring("text", 1, 300), F.lit("[UNCERTAIN]  ")).alias("answer"))


def uncertain_marks(s, d):
    return _answers(s, d).select("answer_id", L.render_doubts(F.col("answer"))["n"].alias("n"), F.sha2(L.render_doubts(F.col("answer"))["text"], 256).alias("shown"), F.sha2(L.strip_doubts(F.col("answer")), 256).alias("plain"))


def uncertain_claims(s, d):
    return L.doubts(_answers(s, d))


def detail_hint(s, d):
    return V.messages(s, d).select("message_id", L.detail_hint(F.when(F.col("message_id") % 2 == 0, F.concat("content", F.lit(" Step by Step"))).otherwise(F.col("content"))).alias("hint"))


def contents_chunk(s, d):
    lines = C.line_chunks(table(s, d, "documents"))
    return L.contents_chunk(lines.withColumn("text", F.when((F.col("chunk_index") == 1) & (F.col("doc_id") % 2 == 0), F.lit("Contents\nChapter one 3\nChapter two 9")).otherwise(F.col("text"))))


def chapter_labels(s, d):
    rows = TQ._sectioned(s, d)
    return L.chapter_labels(rows).select("doc_id", F.array_join("labels", "|").alias("labels"))


def review_actions(s, d):
    ranked = RQ.vector_knn(s, d).withColumnRenamed("vec_id", "doc_id")
    act = V.vector_queries(s, d).select("query_id", F.element_at(F.array(*[F.lit(x) for x in ("filter", "abort", "continue", "expand_doc", "rephrase")]), (F.col("query_id") / 20 % 5 + 1).cast("int")).alias("action"), F.array(F.col("query_id"), F.col("query_id") + 1).alias("keep"))
    return L.review(ranked, act, R.cosine_neighbours(V.vectors(s, d).filter("label = 2"), V.vector_queries(s, d), 3).withColumnRenamed("vec_id", "doc_id"))


def community_passages(s, d):
    g = V.graph(s, d)
    return L.community_chunks(G.communities(g), V.contains(s, d)).select("level", "community", F.size("chunks").alias("n"))


def turn_plan(s, d):
    """A turn for every question: policy by intent, lists by route, floor, feedback, rephrased retry, swap, memories first."""
    lexical, dense = (written(x) for x in RQ._lists(s, d, 10))
    q = V.questions(s, d).withColumn("route", F.element_at(F.array(*map(F.lit, R.ROUTES)), (F.col("query_id") % 4 + 1).cast("int")))
    q = q.withColumn("intent", F.element_at(F.array(*[F.lit(x) for x in ("factual", "personal", "factual", "greeting", "general", "odd", "factual")]), (F.col("query_id") % 7 + 1).cast("int")))
    kinds = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "episodic").when(F.col("doc_id") % 3 == 0, "web").otherwise("document").alias("source_type"))
    ema = feedback_ema(table(s, d, "events")).withColumnRenamed("user_id", "doc_id")
    again = R.bm25(RQ._docs(s, d), q.withColumn("text", F.concat("text", F.lit(" (alternative phrasing)"))), 4)
    return turn.turn(q, {"bm25": lexical, "vector": dense}, kinds, ema, again, least=0.02, retry=0.025, swap=0.033, k=10)


def reflective(s, d):
    said = V.messages(s, d).withColumn("content", F.when(F.col("message_id") % 4 == 0, F.concat(F.lit("so what do  you think of ME, "), "content")).otherwise(F.col("content")))
    return said.select("message_id", L.is_reflective(F.col("content")).alias("reflective"))


_SAID = ["Tell me about tides. ", "i want to test you ", "what is your read on my work? ", "who am I, as a person? ", "نظر من ", "give me my file ", "describe the image "]


def reflective_tiers(s, d):
    """Who is named, and the loose tiers without the strict phrases, over messages that begin in seven ways."""
    said = V.messages(s, d).select("message_id", F.concat(F.element_at(F.array(*map(F.lit, _SAID)), (F.col("message_id") % 7 + 1).cast("int")), F.coalesce("content", F.lit(""))).alias("c"))
    return said.select("message_id", L.refers_to_self(F.col("c")).alias("self"), (L.reflective_recall(F.col("c")) & ~L.is_reflective(F.col("c"))).alias("recall"), L.reflective_anchor(F.col("c")).alias("anchor"))


QUERIES = {f.__name__: f for f in (adaptive_topk, math_filter_retry, general_swap, uncertain_marks, uncertain_claims, detail_hint, contents_chunk, chapter_labels, review_actions, community_passages, reflective, turn_plan, reflective_tiers)}

_I = "i AS (SELECT vec_id AS query_id, ['greeting', 'personal', 'factual', 'general', 'unclear', 'odd'][vec_id % 6 + 1] AS intent FROM embeddings WHERE vec_id % 20 = 0)"
_P = "p AS (SELECT * FROM (VALUES ('greeting', 'none', NULL, 0), ('personal', 'full', 'document,episodic', 8), ('factual', 'full', NULL, 6), ('general', 'none', NULL, 4), ('unclear', 'ask_clarify', NULL, 4)) t(intent, scope, source_types, k))"
_A = "a AS (SELECT doc_id AS answer_id, concat(substring(text, 1, 60), '[UNCERTAIN] and. So it is! Or is it? maybe[UNCERTAIN]', chr(10), substring(text, 1, 300), '[UNCERTAIN]  ') AS answer FROM documents)"
_S = TQ._strip
_CUT = "CASE WHEN contains(b, '. ') THEN string_split(b, '. ')[-1] WHEN contains(b, '! ') THEN string_split(b, '! ')[-1] WHEN contains(b, '? ') THEN string_split(b, '? ')[-1] WHEN contains(b, chr(10)) THEN string_split(b, chr(10))[-1] ELSE b END"

_GONE = f"regexp_replace(q, '{L.GIVE_ME}', ' ', 'g')".replace("i'?m", "i''?m")
_RE = lambda p: p.replace("'", "''")

ORACLES = {
    "reflective_tiers": f"""WITH {V.MESSAGES}, c AS (SELECT message_id, {_S("regexp_replace(lower(concat(" + str(_SAID) + "[message_id % 7 + 1], coalesce(content, ''))), '[\\s]+', ' ', 'g')")} AS q FROM messages)
SELECT message_id, regexp_matches({_GONE}, '{_RE(L.SELF)}') AS self, regexp_matches({_GONE}, '{_RE(L.SELF)}') AND regexp_matches(q, '{_RE(L.OPINION)}') AND NOT regexp_matches(q, '{_RE(L.REFLECTIVE.replace("describe" + chr(92) + "s+me(?!" + chr(92) + "s+(?:a|an|the|how|what|why|to|some|like" + chr(92) + "s+a))", "describe" + chr(92) + "s+me"))}') AS recall,
  regexp_matches(q, '{_RE(L.OPINION)}') OR regexp_matches({_GONE}, '{_RE(L.SELF_OBJECT)}') OR regexp_matches(q, '{_RE(L.SUBJECT)}') AS anchor FROM c""",
    "turn_plan": f"""WITH {RQ._bm25()}, {RQ._bm25('2', 'concat(text, chr(32), chr(40), $$alternative phrasing)$$)')}, {RQ._DENSE}, {RQ._fuse(10)}, {RQ._EMA}, fu AS ({RQ._rank('f', 10)}),
tq AS (SELECT item_id AS query_id, ['cross_document', 'global', 'ambiguous', 'entity'][item_id % 4 + 1] AS route, ['factual', 'personal', 'factual', 'greeting', 'general', 'odd', 'factual'][item_id % 7 + 1] AS intent FROM benchmark),
pl AS (SELECT query_id, route, intent, CASE intent WHEN 'personal' THEN 8 WHEN 'general' THEN 4 ELSE 6 END AS k FROM tq WHERE intent <> 'greeting'),
kinds AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'episodic' WHEN doc_id % 3 = 0 THEN 'web' ELSE 'document' END AS source_type FROM documents),
ro AS (SELECT fu.* FROM fu JOIN pl USING (query_id) WHERE route IN ('cross_document', 'ambiguous') UNION ALL SELECT w.* FROM w JOIN pl USING (query_id) WHERE route = 'global' AND rank <= 10
  UNION ALL SELECT r.* FROM r JOIN pl USING (query_id) WHERE route = 'entity' AND rank <= 10 UNION ALL SELECT w.* FROM w JOIN pl USING (query_id) WHERE route = 'entity' AND rank <= 10 AND query_id NOT IN (SELECT query_id FROM r)),
ty AS (SELECT ro.*, source_type FROM ro JOIN kinds USING (doc_id) JOIN pl USING (query_id) WHERE intent <> 'personal' OR source_type <> 'web'),
th AS (SELECT *, NOT max(score >= 2e-2) OVER (PARTITION BY query_id) AS fallback FROM ty),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fallback THEN 0 ELSE -score END, rank) AS r FROM th WHERE score >= 2e-2 OR fallback) WHERE r <= 10),
nu AS (SELECT query_id, doc_id, source_type, fallback, round(score + 3e-1 * coalesce(ema, 0), 6) AS score FROM cut LEFT JOIN ema ON doc_id = user_id),
ne AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) AS rank FROM nu),
good AS (SELECT query_id FROM ne GROUP BY query_id HAVING max(score) >= 25e-3),
kept AS (SELECT query_id, doc_id, source_type, score, rank, fallback FROM ne WHERE query_id IN (FROM good)
  UNION ALL SELECT r2.query_id, doc_id, source_type, score, rank, false FROM r2 JOIN kinds USING (doc_id) JOIN pl USING (query_id) WHERE rank <= 4 AND (intent <> 'personal' OR source_type <> 'web') AND query_id NOT IN (FROM good)),
sw AS (SELECT pl.query_id, k, CASE WHEN intent = 'factual' AND coalesce(best, -1) < 33e-3 THEN 'general' ELSE intent END AS intent FROM pl LEFT JOIN (SELECT query_id, max(score) AS best FROM kept GROUP BY query_id) USING (query_id))
SELECT query_id, intent, doc_id, source_type, score, rank, fallback FROM (SELECT query_id, doc_id, source_type, score, fallback, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE source_type WHEN 'episodic' THEN 0 ELSE 1 END, rank) AS INTEGER) AS rank FROM kept) JOIN sw USING (query_id) WHERE rank <= k""",
    "adaptive_topk": f"WITH {_I}, {_P} SELECT query_id, intent, coalesce(scope, 'ask_clarify') AS scope, source_types, CASE WHEN coalesce(k, 6) > 0 THEN coalesce(k, 6) END AS final_k, CASE WHEN coalesce(k, 6) > 0 THEN greatest(2 * coalesce(k, 6), 12) END AS vector_k FROM i LEFT JOIN p USING (intent)",
    "math_filter_retry": f"WITH {RQ._knn('label = 3', 'SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 40 = 0')}, {RQ._knn(name='2')} SELECT query_id, vec_id AS doc_id, score, rank, true AS filtered FROM v WHERE rank <= 3 UNION ALL SELECT query_id, vec_id, score, rank, false FROM v2 WHERE rank <= 2 AND query_id NOT IN (SELECT query_id FROM v)",
    "general_swap": f"WITH {_I}, {RQ._knn('label = 9 AND vec_id % 20 <> 0')}, j AS (SELECT query_id, CASE intent WHEN 'odd' THEN 'factual' ELSE intent END AS intent FROM i) SELECT query_id, CASE WHEN intent = 'factual' AND coalesce((SELECT max(score) FROM v WHERE v.query_id = j.query_id), -1) < 25e-2 THEN 'general' ELSE intent END AS intent FROM j",
    "uncertain_marks": f"WITH {_A} SELECT answer_id, CAST(len(string_split(answer, '[UNCERTAIN]')) - 1 AS INTEGER) AS n, sha256(replace(answer, '[UNCERTAIN]', '(uncertain)')) AS shown, sha256(regexp_replace(replace(answer, '[UNCERTAIN]', ''), '\\s+$', '')) AS plain FROM a",
    "uncertain_claims": f"""WITH {_A}, s AS (SELECT answer_id, string_split(answer, '[UNCERTAIN]') AS w FROM a), u AS (SELECT answer_id, unnest(range(1, len(w))) AS i, w FROM s),
t AS (SELECT answer_id, CAST(i - 1 AS INTEGER) AS place, right(array_to_string(w[1:i], '[UNCERTAIN]'), 240) AS b FROM u), c AS (SELECT answer_id, place, {_S(_CUT)} AS claim FROM t)
SELECT answer_id, place, claim FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY place) AS r FROM c WHERE claim <> '') WHERE r <= 2""",
    "detail_hint": f"WITH {V.MESSAGES} SELECT message_id, CASE WHEN regexp_matches(lower(CASE WHEN message_id % 2 = 0 THEN concat(content, ' Step by Step') ELSE content END), '{'|'.join(L.DETAIL)}') THEN 'thorough' ELSE 'to measure' END AS hint FROM messages",
    "contents_chunk": f"""WITH {TQ._LINES}, m AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index = 1 AND doc_id % 2 = 0 THEN concat('Contents', chr(10), 'Chapter one 3', chr(10), 'Chapter two 9') ELSE text END AS text FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM m),
p AS (SELECT doc_id, chunk_index, CASE WHEN regexp_matches(text, '{L.TOC_CUE}') THEN 3 ELSE 0 END + least(5, len(regexp_extract_all(text, '{L.TOC_CHAPTER}'))) + least(5, len([x FOR x IN string_split(text, chr(10)) IF length({_S('x')}) < 60 AND regexp_matches({_S('x')}, '[0-9]$')])) AS points FROM r WHERE r <= greatest(15, n // 12))
SELECT doc_id, chunk_index, CAST(points AS INTEGER) AS points FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, chunk_index) AS k FROM p) WHERE k = 1 AND points >= 4""",
    "chapter_labels": f"""WITH {TQ._MARKED}, l AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM parts))),
k AS (SELECT doc_id, i, CASE WHEN t LIKE '# %' THEN concat('Part ', doc_id) WHEN t LIKE '2_1%' THEN 'Methods of work' ELSE 'Ending here' END AS label FROM l WHERE regexp_matches(t, '^(# |2.1|3\\. )'))
SELECT doc_id, string_agg(label, '|' ORDER BY i) AS labels FROM (SELECT doc_id, label, min(i) AS i FROM k GROUP BY ALL) GROUP BY doc_id""",
    "review_actions": f"""WITH {RQ._knn()}, {RQ._knn('label = 2', name='2')}, q AS (SELECT DISTINCT query_id, ['filter', 'abort', 'continue', 'expand_doc', 'rephrase'][query_id // 20 % 5 + 1] AS action FROM v),
b AS (SELECT query_id, vec_id AS doc_id, score, rank, 0 AS l FROM v JOIN q USING (query_id) WHERE rank <= 10 AND action NOT IN ('abort', 'rephrase') AND (action <> 'filter' OR vec_id IN (query_id, query_id + 1))
  UNION ALL SELECT query_id, vec_id, score, rank, 1 FROM v2 JOIN q USING (query_id) WHERE rank <= 3 AND action IN ('expand_doc', 'rephrase')),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY l, rank) AS d FROM b) WHERE d = 1)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l, rank, doc_id) AS INTEGER) AS rank FROM o""",
}
