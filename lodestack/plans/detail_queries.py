"""Queries of the smaller operators (pages, chapters, memories, profiles, edits, quality with mathematics) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import conversation as D
from ..operators import graph as G
from ..operators import mutations as M
from ..operators import planning as L
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators.replies import tree_from_reply
from ..sources.tables import table
from . import retrieval_queries as RQ
from . import text_queries as TQ
from . import views as V


def quality_sections(s, d):
    """The chain with sections and with mathematics in every second chunk, which the first two checks then let pass."""
    rows = TQ._lines(s, d).withColumn("has_math", F.col("chunk_index") % 2 == 0)
    rows = rows.withColumn("section", F.when(F.col("chunk_index") % 5 == 4, F.concat(F.lit(" 7 References of "), F.col("doc_id").cast("string"))))
    return Q.quality_reason(rows).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "has_math").agg(F.count("*").alias("n"))


def doc_part_labels(s, d):
    """Parts of documents whose heading lines are sections: labels are the first clean one of each part."""
    rows = TQ._sectioned(s, d)
    return D.parts(rows.select("doc_id", "chunk_index", "section"))


def chapter_fill(s, d):
    rows = TQ._sectioned(s, d)
    return C.chapter_fill(rows.select("doc_id", "chunk_index", "section")).select("doc_id", "chunk_index", "chapter")


def page_spans(s, d):
    """Lines as pages; blank ones are skipped."""
    return C.page_spans(C.line_chunks(table(s, d, "documents")).select("doc_id", (F.col("chunk_index") + 1).alias("page"), "text"))


def target_document(s, d):
    """The document of most score among each query's twenty nearest vectors as chunks, ten a document; every seventh document is a memory."""
    hits = R.cosine_neighbours(V.vectors(s, d), V.vector_queries(s, d), 20).withColumn("doc_id", F.floor(F.col("vec_id") / 10))
    hits = hits.select("query_id", "doc_id", F.when(F.col("doc_id") % 7 == 0, "episodic").otherwise("document").alias("source_type"), "score", F.when(F.col("vec_id") % 3 == 0, F.col("score") / 2).alias("rerank"))
    return D.target_document(hits)


def memory_texts(s, d):
    """Documents with headings as files, every second of them Markdown."""
    f = TQ._marked(s, d).select(F.concat(F.lit("memory"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")).alias("path"), "text")
    return C.memory_texts(f).select("path", "n", F.sha2("text", 256).alias("sha"))


def _profile(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("topic"), F.element_at(F.array(*[F.lit(x) for x in ("fact", "style", "like", "dislike", "other")]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("polarity"),
                    F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string")).alias("value"), F.round(F.col("c_acctbal") / 10000, 6).alias("confidence"))


def profile_text(s, d):
    return D.profile_text(_profile(s, d))


def prefer(s, d):
    """Profiles after a session's findings: every third customer is found again, surer by a half."""
    p = _profile(s, d)
    found = p.withColumn("k", F.regexp_extract("topic", "([0-9]+)$", 1).cast("long")).filter("k % 3 = 0").withColumn("confidence", F.col("confidence") + 0.5).withColumn("value", F.concat("value", F.lit("!"))).drop("k")
    return M.prefer(p, found).withColumn("confidence", F.round("confidence", 6))


def about_user(s, d):
    """Chunks that hold a longer word of their user's profile, which is made of the first words of the user's documents."""
    docs = table(s, d, "documents")
    profile = docs.filter("doc_id % 10 = 0").select(F.col("source").alias("user_id"), F.regexp_extract("text", "([A-Za-z]{4,})", 1).alias("value"))
    return D.about_user(V.chunks(s, d), profile).select("chunk_id", "doc_id")


def _raw_graph(s, d):
    t = V.triples(s, d)
    return t.select(F.col("head").alias("src"), "relation", F.col("tail").alias("dst"), F.lit(1.0).alias("weight"))


def kg_cleanup(s, d):
    return G.clean(_raw_graph(s, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


def kg_passages_of(s, d):
    phrases = G.neighbours(V.graph(s, d), s.createDataFrame([("r1",)], "node string"), 1).select("node")
    return G.passages_of(V.contains(s, d), phrases)


def kg_find_phrases(s, d):
    """The names of each region's question among the phrase nodes, in whatever case, each once."""
    n = table(s, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("place"), F.explode(F.array(F.concat(F.lit(" N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")))).alias("name"))
    nodes = V.graph(s, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.find_phrases(nodes, n)


def community_search(s, d):
    """Nearest of sixty communities, whose summaries have the first vectors, at two of three levels."""
    c = V.vectors(s, d).filter("vec_id < 60").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("community_id"), (F.col("vec_id") % 3).cast("int").alias("level"), F.array_repeat(F.lit("m"), (F.col("vec_id") % 4).cast("int")).alias("members"), "embedding")
    return L.community_search(c, V.vector_queries(s, d), 5, [0, 2])


def edit_memory(s, d):
    """Documents after an edit of one: its new id comes from its text."""
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    chunks = V.chunks(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), "chunk_index", "text")
    filed = V.assignments(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), "node_id")
    a, b, c = M.edit_memory(docs, chunks, filed, "7", "a new text")
    out = a.select(F.lit("document").alias("kind"), "doc_id", F.sha2("text", 256).alias("v")).unionByName(b.select(F.lit("chunk").alias("kind"), "doc_id", F.sha2("text", 256).alias("v"))).unionByName(c.select(F.lit("filing").alias("kind"), "doc_id", F.col("node_id").alias("v")))
    return out.groupBy("kind", "doc_id", "v").agg(F.count("*").alias("n"))


def tree_reply(s, d):
    """The tree of a reply that files every fourth vector under its label, in a fence, with an invented document at each leaf and an empty leaf."""
    leaf = V.vectors(s, d).filter("vec_id % 4 = 0").groupBy("label").agg(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")).alias("ids"))
    leaf = leaf.select((F.col("label") % 2).alias("p"), F.struct("label", F.struct(F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"), F.concat("ids", F.array(F.lit("invented"))).alias("doc_ids")).alias("n")).alias("x"))
    inner = leaf.groupBy("p").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["n"]).alias("children"))
    top = inner.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.struct(F.concat(F.lit("p"), F.col("p").cast("string")).alias("label"), "children").alias("n")))), lambda x: x["n"]).alias("children"))
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.struct("children").alias("tree"))), F.lit("\n```\nDone."))
    nodes, filings = tree_from_reply(top.select(F.lit(1).alias("tree_id"), reply.alias("reply")), V.vectors(s, d).select(F.col("vec_id").alias("doc_id")))
    n = filings.groupBy("node_id").agg(F.count("*").alias("n_docs"))
    return nodes.join(n, "node_id", "left").select("node_id", "parent_id", "label", "depth", "is_leaf", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (quality_sections, doc_part_labels, chapter_fill, page_spans, target_document, memory_texts, profile_text, prefer, about_user, kg_cleanup, kg_passages_of, kg_find_phrases, community_search, edit_memory, tree_reply)}

_S = TQ._strip
_CH = f"""{TQ._MARKED}, l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM parts))),
c AS (SELECT doc_id, chunk_index, CASE WHEN NOT regexp_matches(t, '^(# |2.1|3\\. )') THEN NULL WHEN t LIKE '# %' THEN concat('Part ', doc_id) WHEN t LIKE '2_1%' THEN 'Methods of work' ELSE 'Ending here' END AS label FROM l)"""
_P = "p AS (SELECT c_custkey, c_nationkey AS user_id, c_name AS topic, ['fact', 'style', 'like', 'dislike', 'other'][c_custkey % 5 + 1] AS polarity, concat(c_mktsegment, ' ', c_custkey) AS value, round(c_acctbal / 10000, 6) AS confidence FROM customer)"
_NEW = "concat('episodic:', substring(sha256(concat('7', chr(31), 'a new text')), 1, 16))"
_Z = TQ._reason("text", "l").replace("CASE WHEN greatest(1, length(s) // 4) < 30", "CASE WHEN chunk_index % 2 <> 0 AND greatest(1, length(s) // 4) < 30").replace("WHEN s <> '' AND length(regexp", "WHEN chunk_index % 2 <> 0 AND s <> '' AND length(regexp").replace("  WHEN len([x FOR x IN rows_ IF regexp_matches(x, '", "  WHEN chunk_index % 5 = 4 THEN 'references_section'\n  WHEN len([x FOR x IN rows_ IF regexp_matches(x, '", 1)

ORACLES = {
    "tree_reply": """WITH l AS (SELECT label, label % 2 AS p, count(*) AS n FROM embeddings WHERE vec_id % 4 = 0 GROUP BY ALL), p AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT p FROM l)),
k AS (SELECT label, n, i, row_number() OVER (PARTITION BY p ORDER BY label) - 1 AS j FROM l JOIN p USING (p))
SELECT 'root' AS node_id, NULL AS parent_id, 'root' AS label, 0 AS depth, false AS is_leaf, 0 AS n_docs UNION ALL SELECT concat('root.', i), 'root', concat('p', p), 1, false, 0 FROM p
UNION ALL SELECT concat('root.', i, '.', j), concat('root.', i), concat('l', label), 2, true, n FROM k""",
    "quality_sections": f"WITH {TQ._LINES}, {_Z} SELECT coalesce(reason, 'kept') AS reason, chunk_index % 2 = 0 AS has_math, count(*) AS n FROM z GROUP BY ALL",
    "doc_part_labels": f"""WITH {_CH}, n AS (SELECT doc_id, max(chunk_index) + 1 AS n, least(max(chunk_index) + 1, 10) AS k FROM c GROUP BY doc_id), p AS (SELECT *, unnest(range(k)) AS part FROM n),
e AS (SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(round_even(part * n / CAST(k AS DOUBLE), 0) AS INTEGER) AS a, CAST(round_even((part + 1) * n / CAST(k AS DOUBLE), 0) - 1 AS INTEGER) AS b FROM p)
SELECT doc_id, part, a AS "first", b AS "last", coalesce(label, concat('Part ', part + 1)) AS label FROM (SELECT e.doc_id, part, a, b, arg_min(label, chunk_index) FILTER (label IS NOT NULL) AS label FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND chunk_index BETWEEN a AND b GROUP BY e.doc_id, part, a, b)""",
    "chapter_fill": f"WITH {_CH} SELECT doc_id, chunk_index, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS chapter FROM c",
    "page_spans": f"""WITH {TQ._LINES}, k AS (SELECT doc_id, chunk_index + 1 AS page, length(text) AS n FROM l WHERE {_S('text')} <> ''), s AS (SELECT *, CAST(coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM k)
SELECT doc_id, page, st AS "start", st + n AS "end" FROM s""",
    "target_document": f"""WITH {RQ._knn()}, h AS (SELECT query_id, vec_id // 10 AS doc_id, CASE WHEN vec_id % 3 = 0 THEN score / 2 ELSE score END AS x FROM v WHERE rank <= 20),
g AS (SELECT query_id, doc_id, round(sum(x), 6) AS s, count(*) AS n FROM h WHERE doc_id % 7 <> 0 GROUP BY ALL)
SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, n DESC, doc_id) AS r FROM g) WHERE r = 1""",
    "memory_texts": f"""WITH {TQ._MARKED}, f AS (SELECT concat('memory', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END) AS path, CASE WHEN doc_id % 2 = 0 THEN regexp_split_to_array(text, '(?m)^#{{1,6}}\\s+') ELSE string_split(text, chr(10)) END AS w FROM parts),
k AS (SELECT path, [y FOR y IN [{_S('x')} FOR x IN w] IF y <> ''] AS w FROM f) SELECT path, CAST(i - 1 AS INTEGER) AS n, sha256(w[i]) AS sha FROM (SELECT path, w, unnest(range(1, len(w) + 1)) AS i FROM k)""",
    "profile_text": f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, topic, polarity) AS r FROM p WHERE confidence >= 5e-1), t AS (SELECT * FROM r WHERE r <= 12),
g AS (SELECT user_id, list_position(['fact', 'style', 'like', 'dislike'], polarity) AS i, concat(['Facts', 'Style', 'Likes', 'Dislikes'][list_position(['fact', 'style', 'like', 'dislike'], polarity)], ': ', string_agg(value, '; ' ORDER BY r)) AS line FROM t WHERE polarity <> 'other' GROUP BY user_id, polarity)
SELECT user_id, string_agg(line, chr(10) ORDER BY i) AS text FROM g GROUP BY user_id""",
    "prefer": f"""WITH {_P}, f AS (SELECT *, least(1e0, confidence + 5e-1) AS c FROM p WHERE c_custkey % 3 = 0 AND confidence + 5e-1 >= 7e-1 AND polarity <> 'other')
SELECT user_id, topic, polarity, CASE WHEN c_custkey IN (SELECT c_custkey FROM f) THEN concat(value, '!') ELSE value END AS value, CASE WHEN c_custkey IN (SELECT c_custkey FROM f) THEN round(least(1e0, confidence + 5e-1), 6) ELSE confidence END AS confidence FROM p""",
    "about_user": f"""WITH {V.CHUNKS}, w AS (SELECT DISTINCT source AS user_id, lower(regexp_extract(text, '[A-Za-z]{{4,}}')) AS w FROM documents WHERE doc_id % 10 = 0)
SELECT chunk_id, doc_id FROM chunks WHERE EXISTS (SELECT 1 FROM w WHERE w.user_id = chunks.user_id AND w <> '' AND contains(lower(chunks.text), w))""",
    "kg_cleanup": f"""WITH r AS (SELECT CASE c_custkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN 'N/A' ELSE concat('Segment ', c_mktsegment) END AS src, CASE WHEN c_custkey % 17 = 0 THEN concat('segment ', lower(c_mktsegment)) ELSE concat('Nation ', c_nationkey) END AS dst FROM customer)
SELECT src, dst, count(*) AS n FROM r WHERE src NOT IN (' ', 'N/A') GROUP BY ALL""",
    "kg_passages_of": f"WITH {V.GRAPH}, {V.CONTAINS}, n AS (SELECT dst AS node FROM graph WHERE src = 'r1' UNION SELECT src FROM graph WHERE dst = 'r1') SELECT DISTINCT dst AS chunk_id FROM contains WHERE src IN (FROM n)",
    "kg_find_phrases": "SELECT n_regionkey AS query_id, concat('n', n_nationkey) AS node, n_nationkey AS place FROM nation",
    "community_search": f"""WITH {RQ._knn('vec_id < 60 AND vec_id % 3 IN (0, 2)')}
SELECT query_id, concat('community::c', vec_id) AS chunk_id, concat('community_level_', vec_id % 3) AS doc_id, concat('Members: ', vec_id % 4, ' chunks') AS section, score, rank FROM
(SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concat('c', vec_id)) AS INTEGER) AS rank FROM v) WHERE rank <= 5""",
    "edit_memory": f"""WITH {V.CHUNKS}, a AS (SELECT 'document' AS kind, CASE WHEN doc_id = 7 THEN {_NEW} ELSE CAST(doc_id AS VARCHAR) END AS doc_id, sha256(CASE WHEN doc_id = 7 THEN 'a new text' ELSE text END) AS v FROM documents
UNION ALL SELECT 'chunk', CASE WHEN doc_id = 7 THEN {_NEW} ELSE CAST(doc_id AS VARCHAR) END, sha256(CASE WHEN doc_id = 7 THEN 'a new text' ELSE text END) FROM chunks WHERE doc_id <> 7 OR chunk_index = 0
UNION ALL SELECT 'filing', CASE WHEN vec_id = 7 THEN {_NEW} ELSE CAST(vec_id AS VARCHAR) END, concat('l', label) FROM embeddings WHERE vec_id % 9 <> 0) SELECT kind, doc_id, v, count(*) AS n FROM a GROUP BY ALL""",
}
