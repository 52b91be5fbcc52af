"""Graph and tree queries and their SQL; iterations are unrolled in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import similar, turn
from ..operators import retrieval as R
from ..operators import taxonomy as X
from ..providers import HashEmbedder
from ..sources.tables import table, written
from . import views as V


def triple_reasons(s, d):
    return G.triple_reason(V.triples(s, d)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def canonical_triples(s, d):
    return G.canonical_triples(V.triples(s, d))


def kg_edges(s, d):
    return G.edges(V.triples(s, d)).select("src", "relation", "dst", F.array_join("chunks", ",").alias("chunks"), "weight")


def kg_contains(s, d):
    return G.contains_edges(V.triples(s, d))


def kg_edge_support(s, d):
    gone = table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("chunk_id"))
    return G.delete_support(G.edges(V.triples(s, d)), gone).select("src", "relation", "dst", F.size("chunks").alias("n"))


def kg_degree_topn(s, d):
    return G.top_nodes(V.graph(s, d))


def kg_top_sources(s, d):
    return G.top_sources(V.graph(s, d))


def kg_viewer(s, d):
    g = V.graph(s, d)
    return G.induced(g, G.top_nodes(g, 30)).select("src", "dst")


def kg_bfs_2hop(s, d):
    return G.neighbours(V.graph(s, d), table(s, d, "nation").filter("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node")))


def kg_undirected(s, d):
    return G.undirected(V.graph(s, d))


def kg_components(s, d):
    g = V.graph(s, d).filter("not (src like 'r%' or dst like 'r%')")
    return G.components(g)


def ppr_unrolled(s, d):
    return G.page_rank(V.graph(s, d), V.seeds(s, d), tolerance=0.0, steps=21).select("query_id", "node", F.round("score", 6).alias("score")).filter("score > 0")


def kg_ppr_passages(s, d):
    g = V.graph(s, d).unionByName(V.contains(s, d))
    return G.passage_scores(G.page_rank(g, V.seeds(s, d), tolerance=0.0, steps=21), V.contains(s, d)).select("query_id", F.col("chunk_id"), F.round("score", 6).alias("score"))


def entity_jaccard(s, d):
    c = table(s, d, "customer").groupBy(F.concat_ws(":", "c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("chunk_id")).agg(F.collect_set(F.col("c_nationkey").cast("string")).alias("names"))
    return G.entity_overlap(c)


def communities(s, d):
    return G.communities(V.graph(s, d))


def ppr_push(s, d):
    """Page rank by pushing residuals; its error is below what is compared."""
    return G.push_page_rank(V.graph(s, d), V.seeds(s, d), epsilon=1e-13).select("query_id", "node", F.round("score", 6).alias("score"), (F.col("error") < 1e-8).alias("near")).filter("score > 0")


def _month_sets(s, d):
    """Customers with the months of their orders; every seventh has one name more that all of those share."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("chunk_id"), F.date_format("o_orderdate", "yyyy-MM").alias("name"))
    hot = table(s, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("chunk_id"), F.lit("everywhere").alias("name"))
    return o.unionByName(hot).groupBy("chunk_id").agg(F.collect_set("name").alias("names"))


def set_join(s, d):
    return G.similar_sets(_month_sets(s, d), 0.4)


def set_classes(s, d):
    return G.set_classes(_month_sets(s, d)).select("chunk_id", "class_id", F.size("names").alias("n"))


def synonym_leaders(s, d):
    """Vectors as phrases, seen in the order of a hash."""
    v = V.vectors(s, d).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("phrase"), F.crc32(F.col("vec_id").cast("string").cast("binary")).alias("place"), "embedding")
    return similar.leaders(v, 0.7)


def trade_triples(s, d):
    """Trades that sell in nations, one a customer; nations have letters for names."""
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("chunk_id"), F.initcap("c_mktsegment").alias("head"), F.lit("sells in").alias("relation"), F.concat(F.lit("Nation "), F.char(65 + F.col("c_nationkey"))).alias("tail"))


def trade_chunks(s, d):
    """Customers as passages; every tenth is gone."""
    return table(s, d, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.col("c_name").alias("text"))


def trade_questions(s, d):
    """A question a region, that names its nations and one trade."""
    n = table(s, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("Nation "), F.char(65 + F.col("n_nationkey"))))), " and ").alias("n"))
    return n.select("query_id", F.concat(F.lit("Who buys in "), "n", F.lit(" from the Building trade?")).alias("text"))


def kg_ppr_retrieve(s, d):
    """From a question's names to passages: exact and near phrases, page rank, passage scores, hydration."""
    t = trade_triples(s, d)
    contains = G.contains_edges(t).withColumn("weight", F.lit(1.0))
    found = turn.graph_retrieve(trade_questions(s, d), G.edges(t), contains, trade_chunks(s, d), HashEmbedder(4096), tolerance=0.0, steps=40)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "text")


def leaf_centroids(s, d):
    return X.centroids(V.vectors(s, d))


def internal_centroids(s, d):
    t = V.tree(s, d)
    return t.select("node_id", "doc_count", F.posexplode("centroid").alias("dim", "x")).select("node_id", "doc_count", "dim", F.round("x", 6).alias("x"))


def doc_centroids(s, d):
    return X.mean_vectors(V.vectors(s, d).withColumn("k", F.col("vec_id") % 7), "k", unit=True).select("k", F.posexplode("centroid").alias("dim", "x")).select("k", "dim", F.round("x", 6).alias("x"))


def _trace(s, d):
    return X.beam_descend(V.vector_queries(s, d), V.tree(s, d), beam=3, least=0.05, floor=0.02, gap=0.1)


def beam_descend(s, d):
    return _trace(s, d)


def docs_cap(s, d):
    return X.capped_leaves(X.leaves_of(_trace(s, d)), V.assignments(s, d), 0.15)


def taxonomy_retrieve(s, d):
    """The nearest vectors among the documents of each query's capped leaves."""
    vectors = V.vectors(s, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    return R.neighbours_below(written(X.node_sets(V.assignments(s, d)).join(vectors, "doc_id")), V.vector_queries(s, d), docs_cap(s, d), 5)


def _open_tree(s, d):
    """The tree with two leaves more that nothing is filed under."""
    more = s.createDataFrame([("l98", "p0", "l98", 2, True), ("l99", "p1", "l99", 2, True)], "node_id string, parent_id string, label string, depth int, is_leaf boolean")
    return V.tree(s, d).unionByName(more, allowMissingColumns=True)


def _unfiled(s, d):
    return V.vectors(s, d).filter("vec_id % 9 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")


def doc_assign(s, d):
    return X.assign(_unfiled(s, d), _open_tree(s, d)).select("doc_id", "node_id", "score", "tied")


def doc_assign_second(s, d):
    return X.assign(_unfiled(s, d), _open_tree(s, d), second=True).select("doc_id", "node_id", "score", "is_primary")


def centroid_refresh(s, d):
    """Centroids after a batch of filings (each unfiled vector under its label) and removals (every seventh), brought up to date along the touched paths."""
    nodes, old = V.tree_nodes(s, d), V.assignments(s, d)
    vectors = V.vectors(s, d).select(F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("l"), F.col("label").cast("string")).alias("node_id"))
    filed, gone = vectors.filter("doc_id % 9 = 0"), old.filter("doc_id % 7 = 0")
    state = written(X.merged(X.state_of(old, vectors), X.state_of(filed, vectors), X.state_of(gone, vectors)))
    touched = filed.select("node_id").unionByName(gone.select("node_id")).distinct()
    t = X.refreshed(V.tree(s, d), state, touched)
    return t.select("node_id", "doc_count", F.posexplode("centroid").alias("dim", "x")).select("node_id", "doc_count", "dim", F.round("x", 6).alias("x"))


def subtree_docs(s, d):
    return X.documents_below(V.tree_nodes(s, d), V.assignments(s, d), "p1")


def node_counts(s, d):
    return X.node_counts(V.tree_nodes(s, d), V.assignments(s, d))


def _texts(s, d):
    return table(s, d, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("text"))


def keyword_scores(s, d):
    return X.keyword_scores(_texts(s, d), "p_brand")


def keyword_extract(s, d):
    return X.keywords(_texts(s, d), "p_brand").select("p_brand", F.array_join("keywords", ",").alias("keywords"))


def keyword_overlap(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.round(X.keyword_overlap(F.split(F.lower("p_type"), " "), F.array(F.lower("p_name"), F.lit("large brushed steel"))), 6).alias("overlap"))


QUERIES = {f.__name__: f for f in (triple_reasons, canonical_triples, kg_edges, kg_contains, kg_edge_support, kg_degree_topn, kg_top_sources, kg_viewer, kg_bfs_2hop, kg_undirected, kg_components, ppr_unrolled, kg_ppr_passages, entity_jaccard,
                                   communities, ppr_push, set_join, set_classes, synonym_leaders, kg_ppr_retrieve, doc_assign_second, centroid_refresh, leaf_centroids, internal_centroids, doc_centroids, beam_descend, docs_cap, taxonomy_retrieve, doc_assign, subtree_docs, node_counts, keyword_scores, keyword_extract, keyword_overlap)}

_KEPT = f"{V.TRIPLES}, kept AS (SELECT * FROM reasons WHERE reason IS NULL)"


def _walk(graph: str, steps: int = 21) -> str:
    """Page rank over table g (src, dst), unrolled; x<steps> is the result."""
    parts = [f"g AS MATERIALIZED ({graph})", "o AS MATERIALIZED (SELECT src, dst, count(*) / CAST(sum(count(*)) OVER (PARTITION BY src) AS DOUBLE) AS share FROM g GROUP BY src, dst)",
             "nodes AS MATERIALIZED (SELECT DISTINCT unnest([src, dst]) AS node FROM g)", "sinks AS MATERIALIZED (SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM o))",
             "x0 AS MATERIALIZED (SELECT query_id, node, weight / sum(weight) OVER (PARTITION BY query_id) AS x FROM seeds WHERE node IN (SELECT node FROM nodes))"]
    for i in range(1, steps + 1):
        parts.append(f"""x{i} AS MATERIALIZED (SELECT query_id, node, sum(x) AS x FROM (SELECT query_id, dst AS node, 5e-1 * x * share AS x FROM x{i - 1} JOIN o ON node = src
  UNION ALL SELECT query_id, node, (5e-1 * coalesce(lost, 0) + 5e-1) * x0.x FROM x0 LEFT JOIN (SELECT query_id, sum(x) AS lost FROM x{i - 1} WHERE node IN (SELECT node FROM sinks) GROUP BY query_id) USING (query_id)) GROUP BY ALL)""")
    return ",\n".join(parts)


def _level(i: int, children: str, least: str, floor: str, gap: str | None, beam: int) -> str:
    """One level of a descent, from f<i-1> (query_id, q, node_id) over children (node_id, parent_id, is_leaf, centroid)."""
    fall = f"OR fall >= {gap}" if gap else ""
    return f"""c{i} AS (SELECT query_id, q, c.node_id, c.is_leaf, round(list_cosine_similarity(q, c.centroid), 6) AS score FROM f{i - 1} f JOIN {children} c ON c.parent_id = f.node_id),
r{i} AS (SELECT *, row_number() OVER w AS r, lag(score) OVER w - score AS fall, max(score) OVER (PARTITION BY query_id) AS best FROM c{i} WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id)),
k{i} AS MATERIALIZED (SELECT *, r = 1 OR (best >= {floor} AND r <= {beam} AND r < coalesce(min(CASE WHEN score < {least} {fall} THEN r END) OVER (PARTITION BY query_id), 1000000)) AS kept FROM r{i}),
f{i} AS (SELECT query_id, q, node_id FROM k{i} WHERE kept AND NOT is_leaf)"""


def _descend(queries: str, least: str, floor: str, gap: str | None, beam: int) -> str:
    return f"""{V.LEAVES}, f0 AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS q, 'root' AS node_id FROM ({queries})),
in_ AS (SELECT node_id, parent_id, false AS is_leaf, centroid FROM inner_), lf AS (SELECT node_id, parent_id, true AS is_leaf, centroid FROM leaf),
{_level(1, 'in_', least, floor, gap, beam)}, {_level(2, 'lf', least, floor, gap, beam)}"""


_ASKED = "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0"
_BEAM = _descend(_ASKED, "5e-2", "2e-2", "1e-1", 3)
_CAP = f"""{_BEAM}, lv AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM k2 WHERE kept),
nw AS (SELECT query_id, lv.node_id, score, r, sum(doc_count) OVER (PARTITION BY query_id ORDER BY r) AS run FROM lv JOIN leaf ON leaf.node_id = lv.node_id),
cap AS (SELECT query_id, node_id, score FROM (SELECT *, max(run > greatest(1, CAST(floor((SELECT count(*) FROM filed) * 15e-2) AS BIGINT))) OVER (PARTITION BY query_id ORDER BY r) AS over FROM nw) WHERE r = 1 OR NOT over)"""
_OPEN = """in_ AS (SELECT node_id, parent_id, false AS is_leaf, centroid FROM inner_), lf AS (SELECT node_id, parent_id, true AS is_leaf, centroid FROM leaf UNION ALL SELECT 'l98', 'p0', true, NULL UNION ALL SELECT 'l99', 'p1', true, NULL)"""
_ASSIGN = f"""{V.LEAVES}, f0 AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q, 'root' AS node_id FROM embeddings WHERE vec_id % 9 = 0), {_OPEN},
{_level(1, 'in_', '-2e0', '-2e0', None, 1)}, {_level(2, 'lf', '-2e0', '-2e0', None, 1).replace('round(list_cosine_similarity(q, c.centroid), 6)', 'coalesce(round(list_cosine_similarity(q, c.centroid), 6), 0)')},
w AS (SELECT query_id, 1 AS depth, score, r FROM k1 UNION ALL SELECT query_id, 2, score, r FROM k2),
t AS (SELECT query_id, max(tied) AS tied FROM (SELECT a.query_id, coalesce(a.score - b.score < 5e-2 OR (a.score >= 5e-1 AND b.score >= 5e-1), false) AS tied FROM w a LEFT JOIN w b ON a.query_id = b.query_id AND a.depth = b.depth AND b.r = 2 WHERE a.r = 1) GROUP BY query_id)"""
_SETS = "e AS (SELECT DISTINCT o_custkey AS chunk_id, strftime(o_orderdate, '%Y-%m') AS name FROM orders UNION ALL SELECT c_custkey, 'everywhere' FROM customer WHERE c_custkey % 7 = 0)"
_AFTER = V.LEAVES[len(V.ASSIGNMENTS) + 1:].strip()
_TOKENS = "[x FOR x IN regexp_extract_all(lower(concat_ws(' ', p_name, p_type)), '[a-z][a-z0-9_'']*') IF length(x) > 2 AND x NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.keyword_tokens.__globals__["STOP_EN"]) + ")]"

ORACLES = {
    "triple_reasons": f"WITH {V.TRIPLES} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY ALL",
    "canonical_triples": f"WITH {_KEPT} SELECT sha256(concat(head, chr(124), relation, chr(124), tail)) AS key, head, relation, tail, count(*) AS freq, min(chunk_id) AS first_chunk FROM kept GROUP BY ALL",
    "kg_edges": f"WITH {_KEPT} SELECT head AS src, relation, tail AS dst, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunks, 1e0 AS weight FROM kept GROUP BY ALL",
    "kg_contains": f"WITH {_KEPT} SELECT DISTINCT unnest([head, tail]) AS src, 'contains' AS relation, chunk_id AS dst FROM kept",
    "kg_edge_support": f"WITH {_KEPT} SELECT head AS src, relation, tail AS dst, CAST(count(DISTINCT chunk_id) AS INTEGER) AS n FROM kept WHERE CAST(chunk_id AS BIGINT) % 2 = 1 GROUP BY ALL",
    "kg_degree_topn": f"WITH {V.GRAPH} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM graph UNION ALL SELECT dst FROM graph WHERE src <> dst) GROUP BY node ORDER BY degree DESC, node LIMIT 20",
    "kg_top_sources": f"WITH {V.GRAPH} SELECT src AS node, count(*) AS n FROM graph GROUP BY src ORDER BY n DESC, node LIMIT 10",
    "kg_viewer": f"WITH {V.GRAPH}, t AS (SELECT node FROM (SELECT src AS node FROM graph UNION ALL SELECT dst FROM graph WHERE src <> dst) GROUP BY node ORDER BY count(*) DESC, node LIMIT 30) SELECT src, dst FROM graph WHERE src IN (FROM t) AND dst IN (FROM t)",
    "kg_bfs_2hop": f"""WITH {V.GRAPH}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM graph UNION ALL SELECT dst, src FROM graph)), s AS (SELECT concat('n', n_nationkey) AS seed FROM nation WHERE n_nationkey % 5 = 0),
h1 AS (SELECT DISTINCT seed, dst AS node FROM s JOIN b ON src = seed WHERE dst <> seed), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN b ON src = node WHERE dst <> seed)
SELECT seed, node, CAST(min(h) AS INTEGER) AS hops FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL""",
    "kg_undirected": f"WITH {V.GRAPH} SELECT least(src, dst) AS u, greatest(src, dst) AS v, CAST(count(*) AS DOUBLE) AS weight FROM graph WHERE src <> dst GROUP BY ALL",
    "kg_components": f"""WITH {V.GRAPH}, b AS (SELECT src, dst FROM graph WHERE NOT (src LIKE 'r%' OR dst LIKE 'r%')), m AS (SELECT dst AS n, least(dst, min(src)) AS component FROM b GROUP BY dst)
SELECT node, component FROM (SELECT src AS node, component FROM b JOIN m ON n = dst UNION ALL SELECT n, component FROM m)""",
    "ppr_unrolled": f"WITH {V.GRAPH}, {V.SEEDS}, {_walk('SELECT src, dst FROM graph')} SELECT query_id, node, score FROM (SELECT query_id, node, round(x, 6) AS score FROM x21) WHERE score > 0",
    "kg_ppr_passages": f"""WITH {V.GRAPH}, {V.CONTAINS}, {V.SEEDS}, {_walk('SELECT src, dst FROM graph UNION ALL SELECT src, dst FROM contains')},
p AS (SELECT query_id, c.dst AS chunk_id, sum(x) AS said FROM x21 JOIN contains c ON c.src = node GROUP BY ALL),
t AS (SELECT p.query_id, chunk_id, round(5e-1 * coalesce(x, 0) + 5e-1 * said, 9) AS score FROM p LEFT JOIN x21 ON x21.query_id = p.query_id AND node = chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM t) WHERE r <= 10""",
    "entity_jaccard": """WITH e AS (SELECT DISTINCT concat(c_mktsegment, ':', c_custkey % 7) AS chunk_id, c_nationkey AS name FROM customer), n AS (SELECT chunk_id, count(*) AS n FROM e GROUP BY ALL)
SELECT a, b, shared, round(shared / CAST(x.n + y.n - shared AS DOUBLE), 6) AS jaccard FROM (SELECT u.chunk_id AS a, v.chunk_id AS b, count(*) AS shared FROM e u JOIN e v ON u.name = v.name AND u.chunk_id < v.chunk_id GROUP BY ALL) JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b""",
    "leaf_centroids": "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL",
    "internal_centroids": f"""WITH {V.LEAVES}, r AS (SELECT 'root' AS node_id, list(m ORDER BY i) AS centroid FROM (SELECT i, avg(centroid[i]) AS m FROM (SELECT *, unnest(range(1, len(centroid) + 1)) AS i FROM inner_) GROUP BY i)),
t AS (SELECT node_id, doc_count, centroid FROM leaf UNION ALL SELECT node_id, (SELECT sum(doc_count) FROM leaf l WHERE l.parent_id = inner_.node_id), centroid FROM inner_ UNION ALL SELECT node_id, (SELECT sum(doc_count) FROM leaf), centroid FROM r)
SELECT node_id, CAST(doc_count AS BIGINT) AS doc_count, CAST(i - 1 AS INTEGER) AS dim, round(centroid[i], 6) AS x FROM (SELECT *, unnest(range(1, len(centroid) + 1)) AS i FROM t)""",
    "doc_centroids": "WITH m AS (SELECT vec_id % 7 AS k, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) SELECT k, CAST(i - 1 AS INTEGER) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY k)), 6) AS x FROM m",
    "beam_descend": f"WITH {_BEAM} SELECT query_id, 1 AS depth, node_id, score, kept, is_leaf FROM k1 UNION ALL SELECT query_id, 2, node_id, score, kept, is_leaf FROM k2",
    "docs_cap": f"WITH {_CAP} SELECT * FROM cap",
    "taxonomy_retrieve": f"""WITH {_CAP}, s AS (SELECT query_id, doc_id, least(1, greatest(0, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 5))) AS score FROM cap JOIN filed USING (node_id) JOIN f0 USING (query_id))
SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "doc_assign": f"WITH {_ASSIGN} SELECT query_id AS doc_id, node_id, score, tied FROM k2 JOIN t USING (query_id) WHERE kept",
    "doc_assign_second": f"""WITH {_ASSIGN}, u AS (SELECT query_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS second FROM k2 WHERE NOT kept) WHERE second = 1)
SELECT query_id AS doc_id, node_id, score, true AS is_primary FROM k2 WHERE kept UNION ALL SELECT u.query_id, u.node_id, u.score, false FROM u JOIN k2 ON k2.query_id = u.query_id AND kept WHERE u.score >= k2.score - 1e-1""",
    "kg_ppr_retrieve": f"""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS chunk_id, lower(c_mktsegment) AS head, concat('nation ', lower(chr(65 + c_nationkey))) AS tail, c_name FROM customer),
contains AS (SELECT DISTINCT head AS src, chunk_id AS dst FROM t UNION SELECT tail, chunk_id FROM t), ph AS (SELECT DISTINCT unnest([head, tail]) AS node FROM t),
a AS (SELECT CAST(n_regionkey AS BIGINT) AS query_id, concat('nation ', lower(chr(65 + n_nationkey))) AS name FROM nation UNION ALL SELECT DISTINCT CAST(n_regionkey AS BIGINT), 'building' FROM nation),
nr AS (SELECT query_id, node, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY s DESC, node) AS r FROM (SELECT query_id, name, node, CASE WHEN name = node THEN 1e0 WHEN name LIKE 'nation %' AND node LIKE 'nation %' THEN 5e-1 ELSE 0e0 END AS s FROM a, ph) WHERE s > 0) WHERE r <= 3),
seeds AS (SELECT query_id, node, max(s) AS weight FROM nr GROUP BY ALL), {_walk('SELECT DISTINCT head AS src, tail AS dst FROM t UNION ALL SELECT src, dst FROM contains', 40)},
p AS (SELECT query_id, c.dst AS chunk_id, sum(x) AS said FROM x40 JOIN contains c ON c.src = node WHERE CAST(c.dst AS BIGINT) % 10 <> 3 GROUP BY ALL),
k AS (SELECT p.query_id, chunk_id, round(5e-1 * coalesce(x, 0) + 5e-1 * said, 9) AS score FROM p LEFT JOIN x40 ON x40.query_id = p.query_id AND node = chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score, rank, c_name AS text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM k) JOIN t USING (chunk_id) WHERE rank <= 10""",
    "ppr_push": f"WITH {V.GRAPH}, {V.SEEDS}, {_walk('SELECT src, dst FROM graph', 40)} SELECT query_id, node, score, true AS near FROM (SELECT query_id, node, round(x, 6) AS score FROM x40) WHERE score > 0",
    "set_join": f"""WITH {_SETS}, n AS (SELECT chunk_id, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT min(chunk_id) AS chunk_id FROM (SELECT chunk_id, list(name ORDER BY name) AS names FROM e GROUP BY chunk_id) GROUP BY names), f AS (SELECT e.* FROM e JOIN g USING (chunk_id)),
p AS (SELECT u.chunk_id AS a, v.chunk_id AS b, count(*) AS shared FROM f u JOIN f v ON u.name = v.name AND u.chunk_id < v.chunk_id GROUP BY ALL)
SELECT a, b, shared, round(j, 6) AS jaccard FROM (SELECT a, b, shared, shared / CAST(x.n + y.n - shared AS DOUBLE) AS j FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b) WHERE j >= 4e-1""",
    "set_classes": f"WITH {_SETS}, s AS (SELECT chunk_id, list(name ORDER BY name) AS names FROM e GROUP BY chunk_id) SELECT chunk_id, min(chunk_id) OVER (PARTITION BY names) AS class_id, CAST(len(names) AS INTEGER) AS n FROM s",
    "centroid_refresh": f"""WITH {V.ASSIGNMENTS.replace('vec_id % 9 <> 0', 'vec_id % 9 = 0 OR vec_id % 7 <> 0')}, {_AFTER},
r AS (SELECT 'root' AS node_id, list(m ORDER BY i) AS centroid FROM (SELECT i, avg(centroid[i]) AS m FROM (SELECT *, unnest(range(1, len(centroid) + 1)) AS i FROM inner_) GROUP BY i)),
t AS (SELECT node_id, doc_count, centroid FROM leaf UNION ALL SELECT node_id, (SELECT sum(doc_count) FROM leaf l WHERE l.parent_id = inner_.node_id), centroid FROM inner_ UNION ALL SELECT node_id, (SELECT sum(doc_count) FROM leaf), centroid FROM r)
SELECT node_id, CAST(doc_count AS BIGINT) AS doc_count, CAST(i - 1 AS INTEGER) AS dim, round(centroid[i], 6) AS x FROM (SELECT *, unnest(range(1, len(centroid) + 1)) AS i FROM t)""",
    "subtree_docs": "SELECT vec_id AS doc_id FROM embeddings WHERE vec_id % 9 <> 0 AND label % 2 = 1",
    "node_counts": f"WITH {V.ASSIGNMENTS}, l AS (SELECT node_id, parent_id, count(*) AS n FROM filed GROUP BY ALL) SELECT node_id, n FROM l UNION ALL SELECT parent_id, CAST(sum(n) AS BIGINT) FROM l GROUP BY parent_id UNION ALL SELECT 'root', CAST(sum(n) AS BIGINT) FROM l",
    "keyword_scores": f"""WITH t AS (SELECT p_brand, row_number() OVER () AS t, w FROM (SELECT p_brand, {_TOKENS} AS w FROM part) WHERE len(w) > 0), n AS (SELECT p_brand, count(*) AS n FROM t GROUP BY ALL),
u AS (SELECT p_brand, t, unnest(list_concat(w, [concat(w[i], ' ', w[i + 1]) FOR i IN range(1, len(w))])) AS term FROM t), c AS (SELECT p_brand, term, count(*) AS tf, count(DISTINCT t) AS df FROM u GROUP BY ALL)
SELECT p_brand, term, tf, df, round(tf * (1 - 5e-1 * df / n) * CASE WHEN contains(term, ' ') THEN 14e-1 ELSE 1e0 END * (1 + ln(1 + tf)), 6) AS score FROM c JOIN n USING (p_brand)""",
    "keyword_overlap": "WITH k AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS q, list_concat(string_split(lower(p_name), ' '), ['large', 'brushed', 'steel']) AS n FROM part) SELECT p_partkey, round(len([x FOR x IN n IF list_contains(q, x)]) / CAST(len(n) AS DOUBLE), 6) AS overlap FROM k",
}
