"""Stand-ins of the engine's tables over the given ones, in Spark and in SQL: the same definitions twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def documents(s: SparkSession, d: str) -> DataFrame:
    """A document's user is its source; its title is source and id."""
    return table(s, d, "documents").select("doc_id", F.col("source").alias("user_id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"), F.lit("document").alias("source_type"), "text", "lang")


def chunks(s: SparkSession, d: str) -> DataFrame:
    """A chunk is a line; every fifth is a tombstone."""
    rows = table(s, d, "documents").select("doc_id", F.col("source").alias("user_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "user_id", "chunk_index", "text", F.lit("document").alias("source_type"), (F.col("chunk_index") % 5 == 4).alias("excluded"))


def messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", F.col("text").alias("content"))


def feedback(s: SparkSession, d: str) -> DataFrame:
    """The last event of each message rates it."""
    e = table(s, d, "events").select(((F.col("event_id") % 100) * 1000 + F.col("event_id") % 4).alias("m"), "event_id", (F.col("event_id") % 100).alias("session_id"),
                                    F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("rating"))
    return e.groupBy(F.col("m").cast("string").alias("message_id"), "session_id").agg(F.max_by("rating", "event_id").alias("rating"))


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def question_vectors(s: SparkSession, d: str) -> DataFrame:
    """A question's vector is the one of its number."""
    return questions(s, d).join(vectors(s, d), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def triples(s: SparkSession, d: str) -> DataFrame:
    """Customers in nations, some of them faulty."""
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.cast("string").alias("chunk_id"),
                    F.when(k % 11 == 0, F.lit(" ")).when(k % 11 == 1, F.lit("N/A")).otherwise(F.concat(F.lit("Segment "), F.col("c_mktsegment"))).alias("head"),
                    F.when(k % 13 == 0, F.lit("of")).when(k % 13 == 1, F.lit("--")).otherwise(F.lit(" Sells In")).alias("relation"),
                    F.when(k % 17 == 0, F.concat(F.lit("segment "), F.lower("c_mktsegment"))).otherwise(F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).alias("tail"))


def graph(s: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions; customers name the orders' months (passages)."""
    def named(prefix: str, c: str):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    n = table(s, d, "nation")
    parts = [table(s, d, "customer").select(named("c", "c_custkey").alias("src"), named("n", "c_nationkey").alias("dst")),
             table(s, d, "supplier").select(named("s", "s_suppkey").alias("src"), named("n", "s_nationkey").alias("dst")),
             n.select(named("n", "n_nationkey").alias("src"), named("r", "n_regionkey").alias("dst")), n.select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("dst"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("src", F.lit("in").alias("relation"), "dst", F.lit(1.0).alias("weight"))


def contains(s: SparkSession, d: str) -> DataFrame:
    """Nations named by passages: one a market segment and nation."""
    c = table(s, d, "customer")
    return c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.lit("contains").alias("relation"), F.concat_ws(":", F.lit("p"), "c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("dst"), F.lit(1.0).alias("weight")).distinct()


def seeds(s: SparkSession, d: str) -> DataFrame:
    """Each region's query starts at its nations, one of them twice as heavy."""
    return table(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.when(F.col("n_nationkey") % 5 == 0, 2.0).otherwise(1.0).alias("weight"))


def tree_nodes(s: SparkSession, d: str) -> DataFrame:
    """root, two inner nodes by parity, a leaf a label."""
    leaves = vectors(s, d).select("label").distinct().select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("node_id"), F.concat(F.lit("p"), (F.col("label") % 2).cast("string")).alias("parent_id"), F.lit(2).alias("depth"), F.lit(True).alias("is_leaf"))
    top = s.createDataFrame([("root", None, 0, False), ("p0", "root", 1, False), ("p1", "root", 1, False)], "node_id string, parent_id string, depth int, is_leaf boolean")
    return top.unionByName(leaves).select("node_id", "parent_id", F.col("node_id").alias("label"), "depth", "is_leaf")


def assignments(s: SparkSession, d: str) -> DataFrame:
    """Vectors under their label's leaf; every ninth is unfiled."""
    return vectors(s, d).filter("vec_id % 9 <> 0").select(F.lit("u").alias("user_id"), F.col("vec_id").alias("doc_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("node_id"), F.lit(1.0).alias("score"), F.lit(True).alias("is_primary"))


def tree(s: SparkSession, d: str) -> DataFrame:
    from ..operators import taxonomy as X

    filed = assignments(s, d).join(vectors(s, d).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return X.tree_centroids(tree_nodes(s, d), X.mean_vectors(filed, "node_id"))


# The same in SQL, as common table expressions.
CHUNKS = "chunks AS (SELECT concat(doc_id, ':', i - 1) AS chunk_id, doc_id, source AS user_id, CAST(i - 1 AS INTEGER) AS chunk_index, w[i] AS text, 'document' AS source_type, (i - 1) % 5 = 4 AS excluded FROM (SELECT doc_id, source, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS w FROM documents)))"
MESSAGES = "messages AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, role, text AS content FROM conversations)"
FEEDBACK = "feedback AS (SELECT CAST((event_id % 100) * 1000 + event_id % 4 AS VARCHAR) AS message_id, event_id % 100 AS session_id, arg_max(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END, event_id) AS rating FROM events GROUP BY ALL)"
TRIPLES = """triples AS (SELECT CAST(c_custkey AS VARCHAR) AS chunk_id, lower(trim(CASE c_custkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN 'N/A' ELSE concat('Segment ', c_mktsegment) END)) AS head,
  lower(trim(CASE c_custkey % 13 WHEN 0 THEN 'of' WHEN 1 THEN '--' ELSE ' Sells In' END)) AS relation,
  lower(trim(CASE WHEN c_custkey % 17 = 0 THEN concat('segment ', lower(c_mktsegment)) ELSE concat('Nation ', c_nationkey) END)) AS tail FROM customer),
reasons AS (SELECT *, CASE WHEN head = '' THEN 'empty_head' WHEN relation = '' THEN 'empty_relation' WHEN tail = '' THEN 'empty_tail'
  WHEN NOT (regexp_matches(head, '[A-Za-z0-9]') AND regexp_matches(relation, '[A-Za-z0-9]') AND regexp_matches(tail, '[A-Za-z0-9]')) THEN 'non_alnum'
  WHEN head = 'n/a' THEN 'placeholder' WHEN relation = 'of' THEN 'stop_relation' WHEN head = tail THEN 'self_loop' END AS reason FROM triples)"""
GRAPH = """graph AS (SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier
  UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey) FROM nation)"""
CONTAINS = "contains AS (SELECT DISTINCT concat('n', c_nationkey) AS src, concat('p:', c_mktsegment, ':', c_custkey % 7) AS dst FROM customer)"
SEEDS = "seeds AS (SELECT CAST(n_regionkey AS BIGINT) AS query_id, concat('n', n_nationkey) AS node, CASE WHEN n_nationkey % 5 = 0 THEN 2e0 ELSE 1e0 END AS weight FROM nation)"
ASSIGNMENTS = "filed AS (SELECT vec_id AS doc_id, concat('l', label) AS node_id, concat('p', label % 2) AS parent_id, embedding FROM embeddings WHERE vec_id % 9 <> 0)"
LEAVES = f"""{ASSIGNMENTS},
leaf AS (SELECT node_id, parent_id, list(m ORDER BY i) AS centroid, max(n) AS doc_count FROM (SELECT node_id, parent_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS n FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM filed) GROUP BY ALL) GROUP BY ALL),
inner_ AS (SELECT parent_id AS node_id, 'root' AS parent_id, list(m ORDER BY i) AS centroid FROM (SELECT parent_id, i, avg(centroid[i]) AS m FROM (SELECT *, unnest(range(1, len(centroid) + 1)) AS i FROM leaf) GROUP BY ALL) GROUP BY ALL)"""
