"""Knowledge graph: triples, edges, support, degree, neighbourhoods, page rank, passages, components, communities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capital_runs, strip
from ..sources.tables import written
from .leiden import leiden
from .similar import leaders

# What a triple may not hold.
PLACEHOLDERS = ["<empty>", "<none>", "<null>", "<n/a>", "<unknown>", "<>", "none", "null", "n/a", "na", "unknown", "unspecified", "tbd", "todo", "placeholder", "..."]
STOP_RELATIONS = ["to", "of", "in", "on", "at", "by", "for", "from", "with", "is", "are", "was", "were", "be", "been", "being", "the", "a", "an", "and", "or", "but", "as", "this", "that", "these", "those", "it", "they", "has", "have", "had"]
LONGEST = 200

# Sets of a block, the share of all pairs (one in so many) from which on names are not joined by rows, the names of a matrix, and how many compared
# pairs take the time of one row that is dealt out.
SETS, DENSE, WIDE, ROW = 2048, 16, 512, 500


def canonical(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def triple_key(head: Column, relation: Column, tail: Column) -> Column:
    return F.sha2(F.concat_ws("|", canonical(head), canonical(relation), canonical(tail)), 256)


def triple_reason(triples: DataFrame) -> DataFrame:
    """triples (head, relation, tail) in canonical form with reason, the first that drops one (null: kept)."""
    t = triples.withColumns({c: canonical(F.col(c)) for c in ("head", "relation", "tail")})
    h, r, o = F.col("head"), F.col("relation"), F.col("tail")

    def some(test) -> Column:
        return test(h) | test(r) | test(o)

    reason = (F.when(h == "", "empty_head").when(r == "", "empty_relation").when(o == "", "empty_tail").when(some(lambda c: ~c.rlike("[A-Za-z0-9]")), "non_alnum")
              .when(some(lambda c: c.isin(*PLACEHOLDERS)), "placeholder").when(r.isin(*STOP_RELATIONS), "stop_relation").when(h == o, "self_loop").when(some(lambda c: F.length(c) > LONGEST), "too_long"))
    return t.withColumn("reason", reason)


def line_triples(chunks: DataFrame) -> DataFrame:
    """(chunk_id, head, relation, tail): neighbouring names of a chunk, a rule in place of a model."""
    names = chunks.select("chunk_id", capital_runs(F.col("text")).alias("n")).filter(F.size("n") > 1)
    pairs = names.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.struct(F.get("n", i - 1).alias("head"), F.get("n", i).alias("tail")))).alias("p"))
    return pairs.select("chunk_id", "p.head", F.lit("next").alias("relation"), "p.tail")


def canonical_triples(triples: DataFrame) -> DataFrame:
    """(key, head, relation, tail, freq, first_chunk): valid triples, how often they are said and the first chunk."""
    t = triple_reason(triples).filter("reason is null")
    return t.groupBy(triple_key(F.col("head"), F.col("relation"), F.col("tail")).alias("key"), "head", "relation", "tail").agg(F.count("*").alias("freq"), F.min("chunk_id").alias("first_chunk"))


def edges(triples: DataFrame) -> DataFrame:
    """(src, relation, dst, chunks, weight): one edge a triple with the set of chunks that support it; weight stays 1."""
    t = triple_reason(triples).filter("reason is null")
    return t.groupBy(F.col("head").alias("src"), "relation", F.col("tail").alias("dst")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunks")).withColumn("weight", F.lit(1.0))


def contains_edges(triples: DataFrame) -> DataFrame:
    """(src, relation, dst): each phrase to the chunks that name it."""
    t = triple_reason(triples).filter("reason is null")
    return t.select(F.explode(F.array("head", "tail")).alias("src"), F.lit("contains").alias("relation"), F.col("chunk_id").alias("dst")).distinct()


def delete_support(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the chunks (chunk_id) that go; edges without support left go too."""
    rows = graph.select("*", F.posexplode("chunks").alias("__p", "__c")).join(gone.select(F.col("chunk_id").alias("__c")).distinct(), "__c", "left_anti")
    return rows.groupBy("src", "relation", "dst", "weight").agg(F.array_sort(F.collect_set("__c")).alias("chunks")).select(*graph.columns)


def clean(graph: DataFrame) -> DataFrame:
    """Edges whose ends are neither blank nor placeholders."""
    ok = lambda c: (canonical(F.col(c)) != "") & ~canonical(F.col(c)).isin(*PLACEHOLDERS)
    return graph.filter(ok("src") & ok("dst"))


def adjacency(graph: DataFrame) -> DataFrame:
    """(src, dst, weight): directed, parallel edges summed."""
    return graph.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def undirected(graph: DataFrame) -> DataFrame:
    """(u, v, weight) with u < v: parallel edges of both directions summed, no loops."""
    return graph.filter("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("weight").alias("weight"))


def degrees(graph: DataFrame) -> DataFrame:
    """(node, degree): edges that touch a node, a loop once."""
    return graph.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_nodes(graph: DataFrame, k: int = 20) -> DataFrame:
    return degrees(graph).orderBy(F.desc("degree"), "node").limit(k)


def top_sources(graph: DataFrame, k: int = 10) -> DataFrame:
    return graph.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(k)


def induced(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    n = nodes.select("node")
    return graph.join(n, graph["src"] == n["node"], "left_semi").join(n, graph["dst"] == n["node"], "left_semi")


def neighbours(graph: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node, hops): nodes within depth steps of each seed in either direction, at their least distance, without the seed."""
    both = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = seeds.select(F.col("node").alias("seed"), "node").withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        step = reached.filter(F.col("hops") == hop - 1).join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hops"))
        reached = reached.unionByName(step).groupBy("seed", "node").agg(F.min("hops").alias("hops"))
    return reached.filter("hops > 0")


def passages_of(contains: DataFrame, phrases: DataFrame) -> DataFrame:
    return contains.join(phrases.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("chunk_id")).distinct()


def find_phrases(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, node, place): the nodes a query's entities (query_id, place, name) name exactly, each once, by first place."""
    a = asked.withColumn("node", canonical(F.col("name"))).groupBy("query_id", "node").agg(F.min("place").alias("place"))
    return a.join(nodes.select("node"), "node", "left_semi").select("query_id", "node", "place")


def seed_weights(exact: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, node, weight): exact matches weigh 1, near ones (query_id, node, score) their positive cosine; the greatest stays."""
    both = exact.select("query_id", "node", F.lit(1.0).alias("weight")).unionByName(near.filter("score > 0").select("query_id", "node", F.col("score").alias("weight")))
    return both.groupBy("query_id", "node").agg(F.max("weight").alias("weight"))


def page_rank(graph: DataFrame, seeds: DataFrame, damping: float = 0.5, tolerance: float = 1e-6, steps: int = 50, nodes_limit: int = 1_000_000) -> DataFrame:
    """(query_id, node, score): personalised page rank of each query's seeds (query_id, node, weight).

    x' = d M^T x + d dangling p + (1 - d) p from x = p, until the query's change is below the tolerance; nodes of score 0 are left out. Of a seed given twice
    the greatest weight counts. A graph of at most nodes_limit edges (counted) goes to the tasks as arrays, and queries are spread over them. A larger one is
    folded first (see folded); what is still beyond the limit is walked by page_rank_joins. Damping lies in 0..1 and weights are not negative, else ValueError.
    """
    if not 0 <= damping <= 1:
        raise ValueError("damping is between 0 and 1")
    if seeds.filter("weight < 0").limit(1).count():
        raise ValueError("weights are not negative")
    seeds = seeds.groupBy("query_id", "node").agg(F.max("weight").alias("weight"))
    adj = written(adjacency(graph))
    if adj.count() <= nodes_limit:
        return _page_rank_arrays(adj, seeds, damping, tolerance, steps)
    few, members = folded(adj, seeds)
    way = _page_rank_arrays if few.count() <= nodes_limit else page_rank_joins
    ranks = way(few, seeds, damping, tolerance, steps)
    ranks = ranks.join(members.withColumnRenamed("node", "__m"), F.col("node") == F.col("stand"), "left")
    return ranks.select("query_id", F.coalesce("__m", "node").alias("node"), (F.col("score") / F.coalesce("n", F.lit(1))).alias("score"))


def folded(adj: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """adj (src, dst, weight) with fewer sinks, and (node, stand, n): the sink that each sink is folded into, n sinks in all.

    Sinks that start nothing and get the same weights from the same nodes have equal scores at every step, so one of them, with the sum of
    their weights, has the sum of their scores. Whether the in-edges are the same is told by two 64-bit sums of their hashes and their number.
    """
    inner = adj.select(F.col("src").alias("node")).unionByName(seeds.select("node")).distinct()
    sinks = adj.join(inner, adj["dst"] == inner["node"], "left_anti").groupBy(F.col("dst").alias("node"))
    marks = sinks.agg(*[F.bit_xor(F.xxhash64(F.lit(i), "src", "weight")).alias(f"h{i}") for i in (1, 2)], F.count("*").alias("edges"))
    marks = written(marks)
    stands = marks.groupBy("h1", "h2", "edges").agg(F.min("node").alias("stand"), F.count("*").alias("n"))
    members = written(marks.join(stands, ["h1", "h2", "edges"]).select("node", "stand", "n"))
    few = adj.join(members.select(F.col("node").alias("dst"), "stand"), "dst", "left").groupBy("src", F.coalesce("stand", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    return written(few), members


def _page_rank_arrays(adj: DataFrame, seeds: DataFrame, damping: float, tolerance: float, steps: int) -> DataFrame:
    """page_rank of a graph that one task holds."""
    pdf = adj.toPandas()
    names, code = np.unique(np.concatenate([pdf["src"], pdf["dst"]]).astype(str), return_inverse=True)
    src, dst, w = code[:len(pdf)], code[len(pdf):], pdf["weight"].to_numpy(float)
    out = np.bincount(src, w, len(names))
    held = adj.sparkSession.sparkContext.broadcast((names, src, dst, w / out[src], out == 0))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        names, src, dst, share, dangling = held.value
        p, at = np.zeros(len(names)), np.searchsorted(names, pdf["node"].to_numpy(str))
        ok = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == pdf["node"].to_numpy(str))
        p[at[ok]] = pdf["weight"].to_numpy(float)[ok]
        if p.sum() <= 0:
            return pd.DataFrame({"query_id": pdf["query_id"].iloc[:0], "node": pd.Series([], dtype="object"), "score": pd.Series([], dtype="float64")})
        p /= p.sum()
        x = p
        for _ in range(steps):
            y = damping * np.bincount(dst, x[src] * share, len(names)) + (damping * x[dangling].sum() + 1 - damping) * p
            x, change = y, np.abs(y - x).sum()
            if change < tolerance:
                break
        some = x > 0
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "node": names[some].astype(object), "score": x[some]})

    kind = seeds.schema["query_id"].dataType.simpleString()
    return seeds.groupBy("query_id").applyInPandas(walk, f"query_id {kind}, node string, score double")


def page_rank_joins(adj: DataFrame, seeds: DataFrame, damping: float = 0.5, tolerance: float = 1e-6, steps: int = 50) -> DataFrame:
    """page_rank by joins, for graphs beyond one task: each step is written, so that lineage ends there."""
    share = written(adj.join(adj.groupBy("src").agg(F.sum("weight").alias("o")), "src").select("src", "dst", (F.col("weight") / F.col("o")).alias("share")))
    nodes = share.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = seeds.join(nodes, "node", "left_semi")
    p = written(known.join(known.groupBy("query_id").agg(F.sum("weight").alias("o")).filter("o > 0"), "query_id").select("query_id", "node", (F.col("weight") / F.col("o")).alias("p")))
    sinks = written(nodes.join(share.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
    x, done = p.withColumnRenamed("p", "x"), []
    for _ in range(steps):
        flow = x.join(share, x["node"] == share["src"]).select("query_id", F.col("dst").alias("node"), (F.lit(damping) * F.col("x") * F.col("share")).alias("x"))
        lost = x.join(sinks, "node", "left_semi").groupBy("query_id").agg(F.sum("x").alias("lost"))
        back = p.join(x.select("query_id").distinct(), "query_id", "left_semi").join(lost, "query_id", "left").select("query_id", "node", ((damping * F.coalesce("lost", F.lit(0.0)) + (1 - damping)) * F.col("p")).alias("x"))
        old = x.select("query_id", "node", (-F.col("x")).alias("d"), F.lit(0.0).alias("x"))
        new = flow.unionByName(back).select("query_id", "node", F.col("x").alias("d"), "x").unionByName(old)
        new = written(new.groupBy("query_id", "node").agg(F.sum("x").alias("x"), F.abs(F.sum("d")).alias("d")))
        calm = written(new.groupBy("query_id").agg(F.sum("d").alias("c")).filter(F.col("c") < tolerance).select("query_id"))
        done.append(new.join(calm, "query_id", "left_semi").filter("x > 0").drop("d"))
        x = new.join(calm, "query_id", "left_anti").filter("x > 0").drop("d")
        if x.isEmpty():
            break
    for d in done:
        x = x.unionByName(d)
    return x.select("query_id", "node", F.col("x").alias("score"))


def push_page_rank(graph: DataFrame, seeds: DataFrame, damping: float = 0.5, epsilon: float = 1e-9, steps: int = 200) -> DataFrame:
    """(query_id, node, score, error): page rank by pushing residuals outward from the seeds; only nodes near a query's seeds are ever touched.

    Every node keeps a score and a residual. A node whose residual is at least epsilon keeps 1 - damping of it and sends the
    rest along its edges; what sinks send is lost, which the final division by the scores' sum makes up for, as lost mass returns to the
    seeds in proportion. error bounds the L1 distance to the exact scores: twice the residual left over the sum. Each step is
    one join of the nodes that push and one sum, written. Seeds as in page_rank; damping lies in 0 up to below 1, else ValueError.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping is at least 0 and below 1")
    adj = adjacency(graph)
    share = written(adj.join(adj.groupBy("src").agg(F.sum("weight").alias("o")), "src").select("src", "dst", (F.col("weight") / F.col("o")).alias("share")))
    nodes = share.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = seeds.groupBy("query_id", "node").agg(F.max("weight").alias("weight")).filter("weight > 0").join(nodes, "node", "left_semi")
    state = written(known.join(known.groupBy("query_id").agg(F.sum("weight").alias("o")), "query_id").select("query_id", "node", F.lit(0.0).alias("y"), (F.col("weight") / F.col("o")).alias("r")))
    push = F.col("r") >= epsilon
    for _ in range(steps):
        if state.filter(push).isEmpty():
            break
        sent = state.filter(push).join(share, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"), F.lit(0.0).alias("y"), (F.lit(damping) * F.col("r") * F.col("share")).alias("r"))
        kept = state.select("query_id", "node", F.when(push, F.col("y") + (1 - damping) * F.col("r")).otherwise(F.col("y")).alias("y"), F.when(push, 0.0).otherwise(F.col("r")).alias("r"))
        state = written(kept.unionByName(sent).groupBy("query_id", "node").agg(F.sum("y").alias("y"), F.sum("r").alias("r")))
    total = state.groupBy("query_id").agg(F.sum("y").alias("m"), F.sum("r").alias("left"))
    return state.filter("y > 0").join(total, "query_id").select("query_id", "node", (F.col("y") / F.col("m")).alias("score"), (2 * F.col("left") / F.col("m")).alias("error"))


def passage_scores(ranks: DataFrame, contains: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, rank): alpha times a passage's own rank and the rest from the phrases that name it."""
    own = ranks.select("query_id", F.col("node").alias("chunk_id"), F.col("score").alias("own"))
    said = ranks.join(contains.select("src", "dst").distinct(), F.col("node") == F.col("src")).groupBy("query_id", F.col("dst").alias("chunk_id")).agg(F.sum("score").alias("said"))
    both = said.join(own, ["query_id", "chunk_id"], "left").withColumn("score", F.round(alpha * F.coalesce("own", F.lit(0.0)) + (1 - alpha) * F.col("said"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def components(graph: DataFrame) -> DataFrame:
    """(node, component): the least node that each node reaches in either direction; every round is written and roots jump."""
    both = written(graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy(F.col("src").alias("n")).agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["n"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("x"), F.col("component").alias("y"))
        step = written(step.join(up, step["c"] == up["x"], "left").select("node", F.least("c", F.coalesce("y", "c")).alias("component"), "old"))
        labels = step.select("node", "component")
        if step.filter("component <> old").isEmpty():
            return labels


def entity_overlap(chunks: DataFrame, names: str = "names") -> DataFrame:
    """(a, b, shared, jaccard): chunks (chunk_id, names) that share a name; only they meet."""
    rows = chunks.select("chunk_id", F.explode(F.array_distinct(names)).alias("name"))
    size = chunks.select("chunk_id", F.size(F.array_distinct(names)).alias("n"))
    both = rows.alias("x").join(rows.alias("y"), (F.col("x.name") == F.col("y.name")) & (F.col("x.chunk_id") < F.col("y.chunk_id"))).groupBy(F.col("x.chunk_id").alias("a"), F.col("y.chunk_id").alias("b")).agg(F.count("*").alias("shared"))
    out = both.join(size.select(F.col("chunk_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("chunk_id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def communities(graph: DataFrame, members_least: int = 3) -> DataFrame:
    """(level, community, node): Leiden communities of phrases at each resolution (see leiden); those of fewer members are left out."""
    found = leiden(undirected(graph))
    large = found.groupBy("level", "community").count().filter(F.col("count") >= members_least)
    return found.join(large, ["level", "community"], "left_semi").select("level", "community", "node")


def merge_synonyms(phrases: DataFrame, least: float = 0.8) -> DataFrame:
    """(phrase, leader): phrases (phrase, place, embedding), each led by the earlier leader of the best cosine of at least `least`, else itself (see similar)."""
    return leaders(phrases, least).select("phrase", "leader")


def set_classes(chunks: DataFrame, names: str = "names") -> DataFrame:
    """(chunk_id, class_id, names): chunks with equal sets of names form a class, named by its least chunk; null sets are empty ones."""
    rows = _name_sets(chunks, names)
    return rows.join(rows.groupBy("names").agg(F.min("chunk_id").alias("class_id")), "names").select("chunk_id", "class_id", "names")


def _name_sets(chunks: DataFrame, names: str) -> DataFrame:
    return chunks.select("chunk_id", F.array_sort(F.array_distinct(F.array_compact(F.coalesce(names, F.array().cast(chunks.schema[names].dataType))))).alias("names"))


def similar_sets(chunks: DataFrame, least: float, names: str = "names") -> DataFrame:
    """(a, b, shared, jaccard): pairs of classes (set_classes) whose sets of names have a Jaccard likeness of at least `least` (above 0).

    Names are ordered from the rarest on. Sets that are alike enough share a name among the first n - ceil(least n) + 1 of
    either, so only those names are joined, by rows, and a common name is joined only where sets have hardly any other; the sizes and what is left behind
    the shared places bound the overlap before sets are compared. Where those names would join as many rows as one in DENSE of all pairs, sets meet at
    the two rarest names they share (_pair_sets), or, where that would take longer, all pairs are compared by matrices of two blocks of about SETS sets
    a task. Copies meet as one class and empty sets are alike to none.
    """
    if not 0 < least <= 1:
        raise ValueError("the likeness is above 0 and at most 1")
    sets = _name_sets(chunks, names).filter("size(names) > 0").groupBy("names").agg(F.min("chunk_id").alias("id")).filter("id is not null").dropDuplicates(["id"])
    flat = sets.select("id", F.size("names").alias("n"), F.explode("names").alias("name"))
    # numbers stand for names, in their order: how often, and what the buckets of a hash number on their own
    bucket = F.pmod(F.xxhash64("name"), F.lit(64))
    known = flat.groupBy("name").agg(F.count("*").alias("df")).withColumn("bucket", bucket)
    number = (F.row_number().over(Window.partitionBy("bucket").orderBy("name")).cast("long") * 64 + F.col("bucket")).cast("int")
    known = known.select("name", (F.shiftleft(F.col("df").cast("int").cast("long"), 32) + number).alias("code"))
    ranked = written(flat.join(known, "name").groupBy("id", "n").agg(F.array_sort(F.collect_list("code")).alias("t")))
    n = ranked.count()
    keep = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    first = ranked.select("id", "n", F.posexplode(F.slice("t", 1, keep)).alias("p", "name"))
    meet = first.groupBy("name").count().agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2)).first()[0] or 0.0
    if meet * DENSE > n * (n - 1) / 2:
        return _pair_sets(ranked, least, n * (n - 1) / 2) or _dense_sets(ranked, least, math.ceil(n / SETS))
    x, y = (first.select("name", *[F.col(c).alias(f"{c}{k}") for c in ("id", "n", "p")]) for k in "ab")
    fits = (F.col("ida") < F.col("idb")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9)
    # from the first shared name on, where the most is left, all shared names follow
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    met = x.join(y, "name").filter(fits).groupBy("ida", "idb", "na", "nb").agg(F.max(room).alias("room"))
    met = met.filter(F.col("room") >= F.lit(least) / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9)
    both = met.join(ranked.select(F.col("id").alias("ida"), F.col("t").alias("ta")), "ida").join(ranked.select(F.col("id").alias("idb"), F.col("t").alias("tb")), "idb")
    out = both.withColumn("shared", F.size(F.array_intersect("ta", "tb")).cast("long")).withColumn("j", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return out.filter(F.col("j") >= least).select(F.col("ida").alias("a"), F.col("idb").alias("b"), "shared", F.round("j", 6).alias("jaccard"))


def _dense_sets(ranked: DataFrame, least: float, blocks: int) -> DataFrame:
    """similar_sets of (id, n, t) by all pairs of blocks; a task holds two of them and counts their shared names by matrix products."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, own = pdf["id"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["own"].to_numpy()
        rows, code = np.repeat(np.arange(len(pdf)), sizes), pd.factorize(np.concatenate(pdf["t"].to_numpy()))[0]
        some = np.bincount(code)[code] > 1  # a name of one set is shared by none
        rows, code = rows[some], np.unique(code[some], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
        x, y = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        both = np.zeros((len(x), len(y)), np.float32)
        wide = int(code[-1]) + 1 if len(code) else 0
        for lo in range(0, wide, SETS):
            i, j = np.searchsorted(code, (lo, lo + SETS))
            m = np.zeros((len(pdf), min(SETS, wide - lo)), np.float32)
            m[rows[i:j], code[i:j] - lo] = 1
            both += m[x] @ m[y].T
        a, b, shared, likeness = [], [], [], []
        for lo in range(0, len(x), 256):
            part = both[lo:lo + 256].astype(np.int64)
            jac = part / (sizes[x[lo:lo + 256], None] + sizes[None, y] - part)
            near = jac >= least
            if own.min() == own.max():
                near &= np.arange(lo, lo + len(part))[:, None] < np.arange(len(y))[None]
            p, q = np.nonzero(near)
            a.append(ids[x[lo + p]])
            b.append(ids[y[q]])
            shared.append(part[p, q])
            likeness.append(jac[p, q])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "shared": np.concatenate(shared), "j": np.concatenate(likeness)})

    kind = ranked.schema["id"].dataType.simpleString()
    rows = ranked.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.groupBy(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return rows.applyInPandas(compare, f"a {kind}, b {kind}, shared long, j double").select("a", "b", "shared", F.round("j", 6).alias("jaccard"))


def _pair_sets(ranked: DataFrame, least: float, pairs: float) -> DataFrame | None:
    """similar_sets of (id, n, t) where sets meet at the two rarest names they share, or None where comparing all `pairs` takes less time.

    Sets that share k names have the two rarest of these among the first n - k + 2 of either. A set goes to each of those names as the rarer one, where
    many do once for each part of the other names, and a task takes the other names in turn; sets that need share only one name go to single names. A task
    holds about 64 SETS sets at most and puts out pairs as it finds them. It compares sizes that can be alike, only sets with enough names behind the
    two, and drops those that share a rarer name: they meet there.
    """
    short, size, wide, side = math.floor(1 / least + 1e-9), 32 * SETS, WIDE, 2 * WIDE
    keep = (F.col("n") - F.greatest(F.ceil(F.lit(least) * F.col("n") - 1e-9), F.lit(2)) + 2).cast("int")
    count = ranked.agg(F.sum(keep * (keep - 1.0) / 2 + F.when(F.col("n") <= short, F.col("n")).otherwise(0))).first()[0] or 0.0
    if count * ROW > pairs:
        return None
    first = ranked.select("id", "n", "t", keep.alias("keep"), F.posexplode(F.slice("t", 1, keep - 1)).alias("i", "g"))
    others = F.slice("t", F.col("i") + 2, F.col("keep") - F.col("i") - 1)
    one = ranked.filter(F.col("n") <= short).select("id", "n", "t", F.posexplode("t").alias("i", "g")).select("g", F.lit(1).alias("of"), F.lit(-1).alias("part"), "id", "n", "i", "t")
    met = first.select("g", F.explode(others).alias("h")).unionByName(one.select("g", F.lit(-1).alias("h"))).groupBy("g", "h").count().agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2)).first()[0] or 0.0
    if count * ROW + met > pairs:
        return None
    common = first.groupBy("g").count().filter(F.col("count") > 2 * size).select("g", F.ceil(F.col("count") / size).cast("int").alias("of"))
    two = first.join(F.broadcast(common), "g", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    two = two.select("g", "of", F.explode(F.array_distinct(F.transform(others, lambda x: F.pmod(x, F.col("of")).cast("int")))).alias("part"), "id", "n", "i", "t")
    rows = two.unionByName(one)
    large = rows.groupBy("g", "part").count().filter(F.col("count") > 2 * size).select("g", "part", F.ceil(F.col("count") / size).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(large), ["g", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "part", "of", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "n", "i", "t")
    deals = max(2 * ranked.sparkSession.sparkContext.defaultParallelism, math.ceil(count / 65536))

    def needed(both: int) -> int:
        """How many names two sets of `both` names together share at least if they are alike."""
        t = max(int(least / (1 + least) * both) - 1, 0)
        while t / (both - t) < least:
            t += 1
        return t

    def meet(n: np.ndarray, own: np.ndarray, room: np.ndarray, row: np.ndarray, code: np.ndarray, rarer: np.ndarray, width: int, have: int, lo: int, hi: int) -> Iterator[tuple]:
        """(a, b, shared, likeness) of sets that have the same one or two names and, at `row`, others of `code`; in order of block, size and room."""
        start, never = np.searchsorted(row, np.arange(len(n) + 1)), -2.0 * float(n.max())

        def matrix(i: int, j: int, c: int, weight: float) -> np.ndarray:
            m = np.zeros((j - i, min(wide, width - c)), np.float32)
            r, k, w = (v[start[i]:start[j]] for v in (row, code, rarer))
            if width > wide:
                inside = (k >= c) & (k < c + wide)
                r, k, w = r[inside], k[inside], w[inside]
            m[r - i, k - c] = np.where(w, weight, 1)
            return m

        whole = [matrix(0, len(n), 0, w) for w in (1, never)] if width <= wide else None
        runs = {}  # block and size: first row and rooms, the most first
        edge = np.flatnonzero(np.diff(n, prepend=-1) | np.diff(own, prepend=-1)).tolist()
        for i, j in zip(edge, [*edge[1:], len(n)]):
            runs[int(own[i]), int(n[i])] = (i, -room[i:j])
        for (bx, nx), (x, rx) in runs.items():
            for (by, ny), (y, ry) in runs.items():
                t = needed(nx + ny)
                if bx != lo or by != hi or lo == hi and ny < nx or t > min(nx, ny) or (t == 1) != (have == 1):
                    continue
                ex, ey = x + int(np.searchsorted(rx, -t, "right")), y + int(np.searchsorted(ry, -t, "right"))
                for i in range(x, ex, side):
                    for j in range(i if x == y else y, ey, side):
                        u, v = min(i + side, ex), min(j + side, ey)
                        if whole:
                            both = whole[0][i:u] @ whole[1][j:v].T
                        else:
                            both = np.zeros((u - i, v - j), np.float32)
                            for c in range(0, width, wide):
                                both += matrix(i, u, c, 1) @ matrix(j, v, c, never).T
                        near = np.flatnonzero(both.ravel() >= t - have)
                        if len(near):
                            shared = both.ravel()[near].astype(np.int64) + have
                            a, b = near // (v - j) + i, near % (v - j) + j
                            if i == j:
                                a, b, shared = (k[a < b] for k in (a, b, shared))
                            yield a, b, shared, shared / (nx + ny - shared)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        group = group.take(np.lexsort((group["n"].to_numpy(), group["own"].to_numpy())))
        g, part, of, lo, hi = (group[c][0].as_py() for c in ("g", "part", "of", "x", "y"))
        n, i, own = (group[c].to_numpy().astype(np.int64) for c in ("n", "i", "own"))
        flat, ids, kind = group["t"].combine_chunks().flatten().to_numpy(), group["id"].to_numpy(), group["id"].type
        names, code = np.unique(flat, return_inverse=True)
        start, member = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        place, rare, have = np.arange(len(flat)) - start[member], int(np.searchsorted(names, g)), 1 if part < 0 else 2
        last = n - np.maximum(np.ceil(least * n - 1e-9).astype(np.int64), 2) + 2
        at = start + i if part < 0 else np.flatnonzero((place > i[member]) & (place < last[member]) & (flat % of == part))
        room = n[member[at]] - 1 - place[at] + have
        by = np.lexsort((-room, n[member[at]], own[member[at]], code[at]))
        at, room = at[by], room[by]
        edge = np.flatnonzero(np.diff(code[at], prepend=-1)).tolist()
        found, many = [], 0

        def out() -> pa.RecordBatch:
            a, b, shared, j = (np.concatenate(k) for k in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b), kind), pa.array(np.where(a < b, b, a), kind), pa.array(shared, pa.int64()), pa.array(j, pa.float64())], ["a", "b", "shared", "j"])

        for x, y in zip(edge, [*edge[1:], len(at)]):
            m, h = member[at[x:y]], int(code[at[x]])
            if y - x < 2 or lo != hi and own[m[0]] == own[m[-1]]:
                continue
            row = np.repeat(np.arange(y - x), n[m])
            col = code[np.arange(len(row)) + np.repeat(start[m] - (np.cumsum(n[m]) - n[m]), n[m])]
            rest = (col != h) & (col != rare)  # these are shared by all
            row, col, width = row[rest], col[rest], len(names)
            rarer = col < h
            if width > wide:
                _, inverse, often = np.unique(col, return_inverse=True, return_counts=True)
                some = often[inverse] > 1  # a name of one set is shared by none
                row, rarer = row[some], rarer[some]
                used, col = np.unique(col[some], return_inverse=True)
                width = len(used)
            for a, b, shared, j in meet(n[m], own[m], room[x:y], row, col, rarer, width, have, lo, hi):
                found.append((ids[m[a]], ids[m[b]], shared, j))
                many += len(a)
                if many > 1 << 18:
                    yield out()
                    found, many = [], 0
        if found:
            yield out()

    kind = ranked.schema["id"].dataType.simpleString()
    return rows.repartition(deals, "g", "part", "x", "y").groupBy("g", "part", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}, shared long, j double").select("a", "b", "shared", F.round("j", 6).alias("jaccard"))
