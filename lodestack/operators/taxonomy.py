"""The category tree: nodes, filings, centroids, beam descent, keywords, assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_tokens
from ..sources.tables import written

# nodes: (node_id, parent_id, label, depth, is_leaf); assignments: (user_id, doc_id, node_id, score, is_primary)
DEPTH = 6


def mean_vectors(rows: DataFrame, key: str, column: str = "embedding", unit: bool = False) -> DataFrame:
    """(key, centroid, n): mean of the vectors of each key by partial sums a dimension; unit: brought to length 1."""
    flat = rows.filter(F.col(column).isNotNull()).select(key, F.posexplode(column).alias("i", "x"))
    mean = flat.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    out = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"), F.max("n").alias("n"))
    if unit:
        length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
        out = out.withColumn("__l", length).withColumn("centroid", F.transform("centroid", lambda x: F.when(F.col("__l") > 0, x / F.col("__l")).otherwise(x))).drop("__l")
    return out


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label, one row a dimension."""
    return vectors.filter("embedding is not null").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def tree_centroids(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """nodes with centroid and doc_count, from the leaves' (node_id, centroid, n).

    An inner node's centroid is the plain mean of its children's, each child alike whatever its size, and its count their sum;
    a leaf without documents has a null centroid and counts 0. Levels are filled from the deepest up.
    """
    done = nodes.join(leaves, "node_id", "left").select(*nodes.columns, "centroid", F.coalesce("n", F.lit(0)).cast("long").alias("doc_count"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest - 1, -1, -1):
        below = done.filter((F.col("depth") == depth + 1) & F.col("parent_id").isNotNull())
        mean = mean_vectors(below.select(F.col("parent_id").alias("p"), "centroid"), "p", "centroid").select(F.col("p").alias("__p"), F.col("centroid").alias("__c"))
        count = below.groupBy(F.col("parent_id").alias("__q")).agg(F.sum("doc_count").alias("__n"))
        here = (F.col("depth") == depth) & ~F.col("is_leaf")
        done = done.join(mean, F.col("node_id") == F.col("__p"), "left").join(count, F.col("node_id") == F.col("__q"), "left")
        done = done.withColumn("centroid", F.when(here, F.col("__c")).otherwise(F.col("centroid"))).withColumn("doc_count", F.when(here, F.coalesce("__n", F.lit(0))).otherwise(F.col("doc_count"))).drop("__p", "__q", "__c", "__n")
        done = written(done)
    return done


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((size(a) > 0) & (size(b) > 0), dot / (size(a) * size(b))).otherwise(0.0)


def beam_descend(queries: DataFrame, tree: DataFrame, beam: int = 3, least: float = 0.05, floor: float = 0.30, gap: float = 0.10, depth: int = DEPTH, keyword_weight: float = 0.0, missing: float | None = None) -> DataFrame:
    """(query_id, depth, node_id, score, kept, is_leaf): every node considered on the way down, level by level.

    queries (query_id, embedding[, keywords]); tree nodes (node_id, parent_id, label, depth, is_leaf, centroid[, keywords]), rooted where parent_id is null.
    A score is the cosine plus keyword_weight times the keyword overlap; a node without a centroid scores `missing`, by default below `least`.
    Of a level's nodes, best first (ties by label, then id), those of at least `least` go on, or the best alone if none is or its score is below `floor`;
    else the beam is cut before the first fall of `gap` or more, or at `beam`. Kept leaves stay, kept inner nodes are the next level's parents.
    """
    tree = written(tree)
    small = F.broadcast(tree) if tree.count() <= 100_000 else tree
    front = queries.join(F.broadcast(tree.filter("parent_id is null").select("node_id")), how="cross") if tree.filter("parent_id is null").count() == 1 else None
    if front is None:
        raise ValueError("a tree has one root")
    columns, out = ["query_id", "depth", "node_id", "score", "kept", "is_leaf"], None
    front = front.select(*queries.columns, "node_id")
    for _ in range(depth):
        children = front.withColumnRenamed("node_id", "__p").join(small.select("node_id", "parent_id", "label", "depth", "is_leaf", "centroid", *(["keywords"] if keyword_weight else [])).withColumnRenamed("keywords", "__kw"), F.col("__p") == F.col("parent_id"))
        score = F.when(F.col("centroid").isNull(), F.lit(least - 1 if missing is None else missing)).otherwise(cosine(F.col("embedding"), F.col("centroid")) + (keyword_weight * keyword_overlap(F.col("keywords"), F.col("__kw")) if keyword_weight else F.lit(0.0)))
        s = children.withColumn("score", F.round(score, 6))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label", "node_id")
        s = s.withColumn("r", F.row_number().over(w)).withColumn("fall", F.lag("score").over(w) - F.col("score")).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
        s = s.withColumn("cut", F.min(F.when((F.col("score") < least) | ((F.col("fall") >= gap) if gap > 0 else F.lit(False)), F.col("r"))).over(Window.partitionBy("query_id")))
        keep = F.when(F.col("best") < floor, F.col("r") == 1).otherwise((F.col("r") <= beam) & (F.col("r") < F.coalesce("cut", F.lit(1 << 30))))
        s = written(s.withColumn("kept", (F.col("r") == 1) | keep))
        if s.isEmpty():
            break
        out = s.select(*columns) if out is None else out.unionByName(s.select(*columns))
        front = s.filter("kept and not is_leaf").select(*queries.columns, "node_id")
    return out


def leaves_of(trace: DataFrame) -> DataFrame:
    """(query_id, node_id, score) of the kept leaves."""
    return trace.filter("kept and is_leaf").select("query_id", "node_id", "score")


def capped_leaves(leaves: DataFrame, assignments: DataFrame, share: float = 0.5) -> DataFrame:
    """leaves, best first, while the documents below them, each counted once, are at most the share of all documents; at least one."""
    # documents filed under the same nodes are counted together, so no row is made for a query and a document
    sets = written(node_sets(assignments).groupBy("nodes").agg(F.count("*").alias("n")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    most = max(1, int(total * share))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    ranked = leaves.withColumn("r", F.row_number().over(by))
    first = ranked.join(sets.select("nodes", "n", F.explode("nodes").alias("node_id")), "node_id").groupBy("query_id", "nodes").agg(F.min("r").alias("r"), F.max("n").alias("n"))
    new = first.groupBy("query_id", "r").agg(F.sum("n").alias("new"))
    run = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("query_id").orderBy("r"))
    over = F.max((F.col("run") > most).cast("int")).over(Window.partitionBy("query_id").orderBy("r"))
    return ranked.join(new, ["query_id", "r"], "left").withColumn("run", run).withColumn("over", over).filter("r = 1 or over = 0").select("query_id", "node_id", "score")


def node_sets(assignments: DataFrame) -> DataFrame:
    """(doc_id, nodes): the sorted nodes that each document is filed under."""
    return assignments.filter("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def allowed_documents(leaves: DataFrame, assignments: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents of each query's leaves."""
    return leaves.select("query_id", "node_id").join(assignments.select("node_id", "doc_id"), "node_id").select("query_id", "doc_id").distinct()


def subtree(nodes: DataFrame, root: str, depth: int = DEPTH) -> DataFrame:
    """(node_id) of the root and all below it."""
    found = front = nodes.filter(F.col("node_id") == root).select("node_id")
    for _ in range(depth):
        front = nodes.join(front.withColumnRenamed("node_id", "__p"), F.col("parent_id") == F.col("__p")).select("node_id")
        found = found.unionByName(front)
    return found.distinct()


def documents_below(nodes: DataFrame, assignments: DataFrame, root: str) -> DataFrame:
    return assignments.join(subtree(nodes, root), "node_id", "left_semi").select("doc_id").distinct()


def node_counts(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(node_id, n): live filings of a leaf, the sum of the leaves below for an inner node."""
    n = assignments.groupBy("node_id").agg(F.count_distinct("doc_id").alias("n"))
    rows = nodes.join(n, "node_id", "left").select("node_id", "parent_id", F.coalesce("n", F.lit(0)).alias("n"))
    total, up = rows.select("node_id", "n"), rows.filter("parent_id is not null").select(F.col("parent_id").alias("node_id"), "n")
    for _ in range(DEPTH):
        total = total.unionByName(up)
        up = up.join(nodes.select("node_id", "parent_id"), "node_id").filter("parent_id is not null").select(F.col("parent_id").alias("node_id"), "n")
    return total.groupBy("node_id").agg(F.sum("n").cast("long").alias("n"))


def repair_leaves(nodes: DataFrame) -> DataFrame:
    """nodes with is_leaf where they have no children."""
    parents = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("__p")).distinct()
    return nodes.join(parents, F.col("node_id") == F.col("__p"), "left").withColumn("is_leaf", F.col("__p").isNull()).drop("__p")


def move(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """nodes with node under parent and its subtree's depths shifted; ValueError if parent lies below node."""
    below = subtree(nodes, node)
    if below.filter(F.col("node_id") == parent).count():
        raise ValueError("a node cannot move below itself")
    at = nodes.filter(F.col("node_id") == parent).first()
    if at is None:
        raise ValueError("no such parent")
    old = nodes.filter(F.col("node_id") == node).first()
    marks = below.withColumn("__in", F.lit(True))
    out = nodes.join(marks, "node_id", "left").withColumn("depth", F.col("depth") + F.when(F.col("__in"), at["depth"] + 1 - old["depth"]).otherwise(0))
    out = out.withColumn("parent_id", F.when(F.col("node_id") == node, F.lit(parent)).otherwise(F.col("parent_id"))).drop("__in")
    return repair_leaves(out.select(*nodes.columns)).select(*nodes.columns)


def remove(nodes: DataFrame, assignments: DataFrame, node: str, to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and assignments without the subtree; its filings go to the node `to` if one is given."""
    below = subtree(nodes, node)
    kept = assignments.join(below, "node_id", "left_anti")
    if to is not None:
        moved = assignments.join(below, "node_id", "left_semi").withColumn("node_id", F.lit(to))
        kept = kept.unionByName(moved.select(*kept.columns)).dropDuplicates(["user_id", "doc_id", "node_id"])
    return repair_leaves(nodes.join(below, "node_id", "left_anti")).select(*nodes.columns), kept


# How near two children's scores are to be a tie, when both are high, and how near a second leaf is.
TIE, HIGH, SECOND = 0.05, 0.5, 0.1


def assign(vectors: DataFrame, tree: DataFrame, key: str = "doc_id", second: bool = False, **law) -> DataFrame:
    """(key, node_id, score, is_primary, tied): each row's leaf by a descent of one node a level; a node without centroid scores 0.

    tied: at some level the two best are within TIE, or both score HIGH or more, where a model would be asked; the better one is taken. With `second` the
    best leaf that came second at any level is filed too if it is within SECOND of the first one's score.
    """
    trace = written(beam_descend(vectors.select(F.col(key).alias("query_id"), "embedding"), tree, beam=1, least=-2.0, floor=-2.0, gap=0.0, missing=0.0, **law))
    w = Window.partitionBy("query_id", "depth").orderBy(F.desc("kept"), F.desc("score"), "node_id")
    pairs = trace.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    two = pairs.groupBy("query_id", "depth").agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("b"))
    tied = two.groupBy("query_id").agg(F.max(F.coalesce((F.col("a") - F.col("b") < TIE) | ((F.col("a") >= HIGH) & (F.col("b") >= HIGH)), F.lit(False))).alias("tied"))
    first = leaves_of(trace).withColumn("is_primary", F.lit(True))
    if second:
        runner = pairs.filter("r = 2 and is_leaf").groupBy("query_id").agg(F.max(F.struct("score", "node_id")).alias("m")).select("query_id", F.col("m.node_id").alias("node_id"), F.col("m.score").alias("score"))
        near = runner.join(first.select("query_id", F.col("score").alias("s")), "query_id").filter(F.col("score") >= F.col("s") - SECOND)
        first = first.unionByName(near.select("query_id", "node_id", "score", F.lit(False).alias("is_primary")))
    return first.join(tied, "query_id").withColumnRenamed("query_id", key)


def state_of(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node_id, i, total, n): sums of the vectors filed under each leaf, a row a dimension; such states are added up."""
    rows = assignments.select("node_id", "doc_id").join(vectors.filter("embedding is not null").select("doc_id", "embedding"), "doc_id")
    return rows.select("node_id", F.posexplode("embedding").alias("i", "x")).groupBy("node_id", "i").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("*").alias("n"))


def merged(state: DataFrame, filed: DataFrame, removed: DataFrame) -> DataFrame:
    """state after a batch: filed and removed are states of the new and the taken filings (state_of). Only leaves of the batch change."""
    both = state.unionByName(filed).unionByName(removed.select("node_id", "i", (-F.col("total")).alias("total"), (-F.col("n")).alias("n")))
    return both.groupBy("node_id", "i").agg(F.sum("total").alias("total"), F.sum("n").cast("long").alias("n")).filter("n > 0")


def refreshed(tree: DataFrame, state: DataFrame, touched: DataFrame) -> DataFrame:
    """tree (tree_centroids' rows) with centroids and counts of the leaves touched (node_id) and all above them computed anew from state.

    Nothing outside the touched paths is read again: an inner node's mean takes its other children's centroids as they stand.
    """
    means = state.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("total") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("__c"), F.max("n").alias("__n"))
    hit = touched.select("node_id").distinct()
    at = hit.withColumn("__hit", F.lit(True))
    tree = tree.join(at, "node_id", "left").join(means, "node_id", "left")
    new = F.col("__hit").isNotNull() & F.col("is_leaf")
    tree = written(tree.withColumn("centroid", F.when(new, F.col("__c")).otherwise(F.col("centroid"))).withColumn("doc_count", F.when(new, F.coalesce("__n", F.lit(0)).cast("long")).otherwise(F.col("doc_count"))).drop("__hit", "__c", "__n"))
    up = tree.join(hit, "node_id", "left_semi").filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    for _ in range(DEPTH):
        up = written(up)
        if up.isEmpty():
            break
        below = tree.join(up.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
        mean = mean_vectors(below.select(F.col("parent_id").alias("node_id"), "centroid"), "node_id", "centroid").select("node_id", F.col("centroid").alias("__c"))
        count = below.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("doc_count").alias("__n"))
        fresh = up.join(mean, "node_id", "left").join(count, "node_id", "left").withColumn("__hit", F.lit(True))
        tree = written(tree.join(fresh, "node_id", "left").withColumn("centroid", F.when(F.col("__hit"), F.col("__c")).otherwise(F.col("centroid"))).withColumn("doc_count", F.when(F.col("__hit"), F.coalesce("__n", F.lit(0))).otherwise(F.col("doc_count"))).drop("__hit", "__c", "__n"))
        up = tree.join(up, "node_id", "left_semi").filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    return tree


def keyword_overlap(query: Column, node: Column) -> Column:
    """Share of a node's keyword tokens (repeats count) among the query's; 0 where either is empty."""
    split = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.split(x, " ")))
    q, n = split(query), split(node)
    return F.when((F.size(q) > 0) & (F.size(n) > 0), F.size(F.filter(n, lambda x: F.array_contains(q, x))) / F.size(n)).otherwise(0.0)


def keyword_scores(texts: DataFrame, group: str) -> DataFrame:
    """(group, term, tf, df, score): single words and pairs of neighbours of each group's texts (group, text).

    score = tf (1 - df / 2 n) (1 + 0.4 for a pair) (1 + ln(1 + tf)), n the group's texts with words.
    """
    rows = texts.select(group, F.monotonically_increasing_id().alias("__t"), keyword_tokens(F.col("text")).alias("w")).filter("size(w) > 0")
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    per = rows.select(group, "__t", F.explode(F.concat("w", pairs)).alias("term")).groupBy(group, "term", "__t").agg(F.count("*").alias("c"))
    t = per.groupBy(group, "term").agg(F.sum("c").alias("tf"), F.count("*").alias("df")).join(n, group)
    boost = F.when(F.contains("term", F.lit(" ")), 1.4).otherwise(1.0)
    return t.select(group, "term", "tf", "df", F.round(F.col("tf") * (1 - 0.5 * F.col("df") / F.col("n")) * boost * (1 + F.log1p("tf")), 6).alias("score"))


def keywords(texts: DataFrame, group: str, k: int = 8) -> DataFrame:
    """(group, keywords): the best terms of each group, but for words inside a better term.

    A term is passed over only for the words of at most k terms before it, so the first 3 k of each group decide.
    """
    w = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    best = keyword_scores(texts, group).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 3 * k)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, words = [], set()
        for t in pdf.sort_values("r")["term"]:
            if t not in words and len(chosen) < k:
                chosen.append(t)
                words.update(t.split(" "))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "keywords": [chosen]})

    kind = texts.schema[group].dataType.simpleString()
    return best.groupBy(group).applyInPandas(choose, f"{group} {kind}, keywords array<string>")


def build_tree(vectors: DataFrame, branches: int = 4, depth: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, assignments) of (user_id, doc_id, embedding) by bisecting k-means, one fit over all rows a level's parent.

    It stands in for a tree that a model proposes: labels are the nodes' numbers.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = vectors.filter("embedding is not null").withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double")))).withColumn("node_id", F.lit("root"))
    nodes = [("root", None, "root", 0, False)]
    for level in range(1, depth + 1):
        parents = [r[0] for r in rows.groupBy("node_id").count().filter(F.col("count") >= 2 * branches).select("node_id").collect()]  # at most branches ^ (level - 1)
        done = [rows.filter(~F.col("node_id").isin(*parents))] if parents else [rows]
        for p in sorted(parents):
            model = BisectingKMeans(k=branches, seed=seed, maxIter=5).fit(rows.filter(F.col("node_id") == p))
            done.append(model.transform(rows.filter(F.col("node_id") == p)).withColumn("node_id", F.concat(F.lit(p + "."), F.col("prediction"))).drop("prediction"))
            nodes += [(f"{p}.{i}", p, f"{p}.{i}", level, True) for i in range(len(model.clusterCenters()))]
        rows = written(_all(done).drop("features")).withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    table = repair_leaves(spark.createDataFrame(nodes, "node_id string, parent_id string, label string, depth int, is_leaf boolean"))
    return table, rows.select("user_id", "doc_id", "node_id", F.lit(1.0).alias("score"), F.lit(True).alias("is_primary"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
