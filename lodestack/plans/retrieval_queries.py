"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators.catalog import feedback_ema
from ..sources.postings import PostingsIndex
from ..sources.tables import path, table
from ..sources.vector_index import VectorIndex
from . import views as V


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def bm25_search(s, d, k=10):
    return R.bm25(_docs(s, d), V.questions(s, d), k)


def bm25_tenant_filter(s, d):
    docs = table(s, d, "documents")
    scoped = Q.scope(docs, filter_={"$or": [{"lang": "fr"}, {"lang": {"$in": ["de"]}}], "source": {"$ne": "none"}, "unknown": 1})
    return R.bm25(docs.select("doc_id", "text"), V.questions(s, d), 5, scoped.select("doc_id", "text"))


def vector_knn(s, d):
    return R.cosine_neighbours(V.vectors(s, d), V.vector_queries(s, d))


def knn_filtered(s, d):
    return R.cosine_neighbours(Q.scope(V.vectors(s, d), filter_={"label": {"$in": [1, 2, 3]}}), V.vector_queries(s, d), 5)


def knn_allowlist(s, d):
    allowed = V.assignments(s, d).filter("node_id in ('l0', 'l4')").select(F.col("doc_id").alias("vec_id"))
    return R.cosine_neighbours(V.vectors(s, d).join(allowed, "vec_id", "left_semi"), V.vector_queries(s, d), 5)


def _lists(s, d, k=20):
    dense = R.cosine_neighbours(V.vectors(s, d), V.question_vectors(s, d), k).withColumnRenamed("vec_id", "doc_id")
    return R.bm25(_docs(s, d), V.questions(s, d), k), dense


def hybrid_rrf(s, d):
    return R.hybrid(*_lists(s, d))


def router(s, d):
    """Every question by the route of its number: fused, ambiguous, first available, global."""
    lexical, dense = _lists(s, d, 10)
    q = V.questions(s, d).withColumn("route", F.element_at(F.array(*map(F.lit, R.ROUTES)), (F.col("query_id") % 4 + 1).cast("int")))
    return R.route(q, {"bm25": lexical, "vector": dense})


def doc_scope_coarse(s, d):
    """The three documents whose lines score most, and the ranking kept to them."""
    lexical = bm25_search(s, d, 50)
    allowed = R.document_scores(lexical.withColumn("chunk_id", F.col("doc_id")).drop("doc_id"), _docs(s, d).select("doc_id", F.col("doc_id").alias("chunk_id")))
    return R.doc_scope(lexical, allowed)


def rerank_threshold(s, d):
    lexical = bm25_search(s, d).withColumn("rerank", F.col("score") - 60)
    return R.threshold(lexical, 0.0, 5).select("query_id", "doc_id", "rank", "fallback")


def feedback_nudge(s, d):
    ranked = vector_knn(s, d).select("query_id", F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 13 != 0, F.col("score")).alias("rerank"))
    return R.nudge(ranked, feedback_ema(table(s, d, "events")).withColumnRenamed("user_id", "doc_id"))


def context_compression(s, d):
    return R.compress(vector_knn(s, d))


def crag_retry(s, d):
    return R.retry_below(bm25_search(s, d, 5), R.bm25(_docs(s, d), V.questions(s, d).withColumn("text", F.concat("text", F.lit(" (alternative phrasing)"))), 7), 60.0)


def result_union(s, d):
    lexical, dense = _lists(s, d, 5)
    return R.merge_results(lexical, dense)


def review_triggers(s, d):
    ranked = vector_knn(s, d).select("query_id", "score", "rank", F.when(F.col("vec_id") % 7 == 0, "episodic").otherwise("document").alias("source_type"))
    q = V.vector_queries(s, d).select("query_id", (F.col("query_id") % 5).alias("leaves"), F.when(F.col("query_id") % 3 == 0, "unclear").when(F.col("query_id") % 3 == 1, "personal").otherwise("factual").alias("intent"), F.when(F.col("query_id") % 2 == 0, "ambiguous").otherwise("entity").alias("route"))
    return R.review_reasons(ranked, q, 0.3, 0.5).select("query_id", F.array_join("reasons", ",").alias("reasons"))


def passage_format(s, d):
    docs = V.documents(s, d).select("doc_id", "title", F.substring("text", 1, 40).alias("text"), F.lit("").alias("section"))
    return R.passages(bm25_search(s, d, 3).join(docs, "doc_id"))


def ann_search(s, d):
    """The ten nearest by the approximate index over all vectors."""
    return _index(s, d).search(V.vector_queries(s, d))


def ann_filtered(s, d):
    """Five nearest of three labels, the condition acting inside the cells; where a query's cells hold too few, the exact way."""
    return _index(s, d).search(V.vector_queries(s, d), 5, where=F.col("label").isin(1, 2, 3))


def _index(s, d):
    return VectorIndex.build(V.vectors(s, d), path(s), keep=("label",))


def ann_recall(s, d):
    """How many of the ten exact neighbours' places the approximate index fills with a score as good, over all queries."""
    exact = vector_knn(s, d).filter("rank = 10").select("query_id", F.col("score").alias("last"))
    found = ann_search(s, d).join(exact, "query_id").agg(F.count_if(F.col("score") >= F.col("last")).alias("hit"), F.count_distinct("query_id").alias("n_queries"))
    return found.select("n_queries", (F.col("hit") >= 0.9 * 10 * F.col("n_queries")).alias("recall_reached"))


def bm25_kept(s, d):
    """bm25_search from a kept index; its second half is added later, after documents of it and of the first half have gone and come back."""
    docs = _docs(s, d)
    index = PostingsIndex.build(docs.filter("doc_id % 2 = 0"), path(s))
    index.add(docs.filter("doc_id % 2 <> 0"))
    back = docs.filter("doc_id % 10 < 2")
    index.remove(back)
    index.add(back)
    return index.search(V.questions(s, d))


def term_stats(s, d):
    return R.document_frequencies(table(s, d, "documents")).filter("term is not null").select("term", "tf", "df")


QUERIES = {f.__name__: f for f in (bm25_search, bm25_tenant_filter, vector_knn, knn_filtered, knn_allowlist, hybrid_rrf, router, doc_scope_coarse, rerank_threshold, feedback_nudge,
                                   context_compression, crag_retry, result_union, review_triggers, passage_format, term_stats, ann_search, ann_filtered, ann_recall, bm25_kept)}


def _bm25(name: str = "", text: str = "text", where: str = "true") -> str:
    """Scores of all pairs as table r<name> with rank, from documents and benchmark."""
    return f"""
d{name} AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}') AS w FROM documents),
n{name} AS MATERIALIZED (SELECT doc_id, len(w) AS len FROM d{name}),
c{name} AS (SELECT count(*) AS n, avg(len) AS avg_len FROM n{name}),
tf{name} AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d{name}) GROUP BY ALL),
i{name} AS MATERIALIZED (SELECT term, ln((n - count(*) + 5e-1) / (count(*) + 5e-1)) AS raw FROM tf{name}, c{name} GROUP BY term, n),
j{name} AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 25e-2 FROM i{name}) ELSE raw END AS idf FROM i{name}),
q{name} AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]{{2,}}')) AS term FROM benchmark) GROUP BY ALL),
s{name} AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * len / avg_len))), 6) AS score
  FROM tf{name} JOIN j{name} USING (term) JOIN n{name} USING (doc_id) JOIN q{name} USING (term), c{name} GROUP BY ALL),
r{name} AS MATERIALIZED (SELECT query_id, doc_id, coalesce(score, 0e0) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0e0) DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT DISTINCT query_id FROM q{name}) CROSS JOIN (SELECT doc_id FROM documents WHERE {where}) LEFT JOIN s{name} USING (query_id, doc_id))"""


def _knn(where: str = "true", query: str = "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0", name: str = "") -> str:
    return f"""
a{name} AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS q FROM ({query}) WHERE embedding IS NOT NULL),
v{name} AS MATERIALIZED (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM
  (SELECT query_id, vec_id, least(1, greatest(0, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 5))) AS score FROM a{name}, embeddings WHERE embedding IS NOT NULL AND {where}))"""


def _rank(table: str, k: int, order: str = "score DESC, doc_id") -> str:
    return f"SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank FROM {table}) WHERE rank <= {k}"


_QUESTIONS = "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id"
_DENSE = f"{_knn(query=_QUESTIONS)}, w AS (SELECT query_id, vec_id AS doc_id, score, rank FROM v)"


def _fuse(k: int) -> str:
    return f"f AS (SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM r WHERE rank <= {k} UNION ALL SELECT query_id, doc_id, rank FROM w WHERE rank <= {k}) GROUP BY ALL)"


_EMA = """ema AS (SELECT user_id, round(sum(s * pow(7e-1, n - i) * CASE WHEN i = 1 THEN 1e0 ELSE 3e-1 END), 6) AS ema FROM (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 WHEN event_type = 'error' THEN -1e0 END AS s FROM events) WHERE s IS NOT NULL) GROUP BY user_id)"""

ORACLES = {
    "bm25_search": f"WITH {_bm25()} SELECT * FROM r WHERE rank <= 10",
    "bm25_kept": f"WITH {_bm25()} SELECT * FROM r WHERE rank <= 10",
    "ann_recall": "SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL",
    "bm25_tenant_filter": "WITH " + _bm25(where="lang IN ('fr', 'de') AND source IS DISTINCT FROM 'none'") + " SELECT * FROM r WHERE rank <= 5",
    "vector_knn": f"WITH {_knn()} SELECT * FROM v WHERE rank <= 10",
    "knn_filtered": f"WITH {_knn('label IN (1, 2, 3)')} SELECT * FROM v WHERE rank <= 5",
    "knn_allowlist": f"WITH {_knn('label IN (0, 4) AND vec_id % 9 <> 0')} SELECT * FROM v WHERE rank <= 5",
    "hybrid_rrf": f"WITH {_bm25()}, {_DENSE}, {_fuse(20)} {_rank('f', 10)}",
    "router": f"""WITH {_bm25()}, {_DENSE}, {_fuse(10)}, fused AS ({_rank('f', 10)}),
l AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'cross_document' WHEN 1 THEN 'global' WHEN 2 THEN 'ambiguous' ELSE 'entity' END AS route FROM (SELECT DISTINCT item_id AS query_id FROM benchmark))
SELECT fused.*, route FROM fused JOIN l USING (query_id) WHERE route IN ('cross_document', 'ambiguous')
UNION ALL SELECT w.*, route FROM w JOIN l USING (query_id) WHERE route = 'global' AND rank <= 10
UNION ALL SELECT r.*, route FROM r JOIN l USING (query_id) WHERE route = 'entity' AND rank <= 10
UNION ALL SELECT w.*, route FROM w JOIN l USING (query_id) WHERE route = 'entity' AND rank <= 10 AND query_id NOT IN (SELECT query_id FROM r)""",
    "doc_scope_coarse": f"WITH {_bm25()}, p AS (SELECT * FROM r WHERE rank <= 3) {_rank('p', 10)}",
    "rerank_threshold": f"""WITH {_bm25()}, p AS (SELECT query_id, doc_id, rank AS old, score - 60 AS rerank FROM r WHERE rank <= 10), g AS (SELECT *, NOT max(rerank >= 0) OVER (PARTITION BY query_id) AS fallback FROM p)
SELECT query_id, doc_id, rank, fallback FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fallback THEN 0 ELSE -rerank END, old) AS INTEGER) AS rank FROM g WHERE rerank >= 0 OR fallback) WHERE rank <= 5""",
    "feedback_nudge": f"""WITH {_knn()}, {_EMA}, p AS (SELECT query_id, vec_id AS doc_id, CASE WHEN vec_id % 13 <> 0 THEN score END AS rerank FROM v WHERE rank <= 10),
n AS (SELECT query_id, doc_id, rerank, ema, round(rerank + 3e-1 * coalesce(ema, 0), 6) AS score FROM p LEFT JOIN ema ON doc_id = user_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) AS INTEGER) AS rank FROM n""",
    "context_compression": f"WITH {_knn()}, t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM v WHERE rank <= 10) SELECT query_id, vec_id, score, rank FROM t WHERE rank <= (3 * n + 3) // 4",
    "crag_retry": f"WITH {_bm25()}, {_bm25('2', 'concat(text, chr(32), chr(40), $$alternative phrasing)$$)')}, g AS (SELECT query_id FROM r WHERE rank = 1 AND score >= 60) SELECT * FROM r WHERE rank <= 5 AND query_id IN (FROM g) UNION ALL SELECT * FROM r2 WHERE rank <= 7 AND query_id NOT IN (FROM g)",
    "result_union": f"""WITH {_bm25()}, {_DENSE}, b AS (SELECT *, 0 AS l FROM r WHERE rank <= 5 UNION ALL SELECT *, 1 FROM w WHERE rank <= 5),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY l, rank) AS d FROM b) WHERE d = 1)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l, rank, doc_id) AS INTEGER) AS rank FROM o""",
    "review_triggers": f"""WITH {_knn()}, p AS (SELECT *, vec_id % 7 = 0 AS e FROM v WHERE rank <= 10),
g AS (SELECT query_id, max(score) AS m, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b, max(CASE WHEN e THEN score END) AS e FROM p GROUP BY query_id)
SELECT query_id, CASE WHEN query_id % 3 = 1 AND e >= 1e-1 THEN '' ELSE concat_ws(',', CASE WHEN m < 3e-1 THEN 'score_floor' END, CASE WHEN a - b < 5e-1 THEN 'ambiguity_delta' END, CASE WHEN query_id % 5 > 3 THEN 'branch_threshold' END,
  CASE WHEN query_id % 3 = 0 THEN 'intent_unclear' END, CASE WHEN query_id % 2 = 0 THEN 'router_ambiguous' END) END AS reasons FROM g""",
    "passage_format": f"WITH {_bm25()} SELECT query_id, string_agg(concat('[Source ', rank, ' | ', source, '-', doc_id, ']', chr(10), substring(text, 1, 40)), chr(10) || chr(10) ORDER BY rank) AS passages FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id",
    "term_stats": f"WITH {_bm25()} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term",
}
