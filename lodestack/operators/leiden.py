"""Communities by the Leiden method in supersteps over written tables: local moves, refinement, aggregation.

A superstep is joins and sums over all nodes at once, for all resolutions and tries together; no task holds a community or a
component. In a local move each node with tails (a coin by node and step, so that neighbours do not swap forever) goes to the neighbouring
community of the greatest gain w - r k K / 2m; a single node that may leave itself is no goal. The refinement starts with single nodes inside each community: in a step, single nodes with tails
join a part of their own community whose nodes all stay (heads, or parts of two and more), if that gains. A part thus grows by nodes that
have an edge into it and never loses one, so parts are connected. Parts become the nodes of the next graph, each
under its community; when nothing moves, communities themselves do, until nothing is left to join. Then nodes are moved once more in the first graph, communities
in several pieces are split into them, and of a resolution's tries (other coins) the one of the greatest modularity stays.

Nodes with a single neighbour gain nowhere but beside it, so they are folded into it before (see folded) and take its community at the end: supersteps cost
what the other nodes' edges cost, for all resolutions and tries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

# The resolutions of the three levels of communities.
RESOLUTIONS = {0: 0.5, 1: 1.0, 2: 2.0}
LEAST_GAIN = 1e-9


def _rate(resolutions: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in resolutions.items() for x in kv]), F.col("level"))


def _tried(resolutions: dict[int, float], tries: int) -> dict[int, float]:
    """A level of its own for each resolution and try."""
    return {level * tries + t: r for level, r in resolutions.items() for t in range(tries)}


def _links(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, node, c, x): the weight between each node and each community around it, its own included."""
    near = edges.join(labels.select("level", F.col("node").alias("b"), "c"), ["level", "b"]).select("level", F.col("a").alias("node"), "c", "w")
    return near.unionByName(labels.select("level", "node", "c", F.lit(0.0).alias("w"))).groupBy("level", "node", "c").agg(F.sum("w").alias("x"))


def _best(links: DataFrame, labels: DataFrame, rate: Column, two_m: float, goal: Column) -> DataFrame:
    """labels with to, the community of the greatest gain among those where goal holds, and the gain over staying."""
    total = labels.groupBy("level", "c").agg(F.sum("k").alias("s"), F.count("*").alias("size"), F.max("coin").alias("head"))
    own = labels.select("level", "node", F.col("c").alias("own"), "k", "coin", *[c for c in ("home",) if c in labels.columns])
    rows = links.join(total, ["level", "c"]).join(own, ["level", "node"])
    if "home" in labels.columns:
        homes = labels.select("level", "c", F.col("home").alias("there")).distinct()
        rows = rows.join(homes, ["level", "c"])
    stays = F.col("c") == F.col("own")
    gain = F.round(F.col("x") - rate * F.col("k") * (F.col("s") - F.when(stays, F.col("k")).otherwise(0.0)) / F.lit(two_m), 9)
    rows = rows.withColumn("gain", gain).withColumn("stays", stays)
    choice = F.max(F.when(goal & ~F.col("stays"), F.struct("gain", "c")))
    return rows.groupBy("level", "node").agg(choice.alias("m"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("now"), F.max(F.when(F.col("stays"), F.col("size"))).alias("size"))


def _step(edges: DataFrame, labels: DataFrame, rate: Column, two_m: float, step: int, refine: bool) -> DataFrame:
    """labels after a superstep, with moved."""
    labels = labels.withColumn("coin", F.pmod(F.xxhash64("level", "node", F.lit(step)), F.lit(2)))
    goal = (F.col("size") > 1) | (F.col("head") == 1)
    goal = goal & (F.col("there") == F.col("home")) if refine else goal
    best = _best(_links(edges, labels), labels, rate, two_m, goal)
    moves = (F.col("m.gain") > F.col("now") + LEAST_GAIN) & (F.col("coin") == 0)
    if refine:
        moves = moves & (F.col("size") == 1)
    out = labels.join(best, ["level", "node"]).withColumn("moved", F.coalesce(moves, F.lit(False)))
    return written(out.withColumn("c", F.when(F.col("moved"), F.col("m.c")).otherwise(F.col("c"))).drop("m", "now", "size", "coin"))


def folded(near: DataFrame, two_m: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(node, k) that stay and (leaf, node, w) folded into them, from both directions (a, b, w) of the edges.

    A leaf has one neighbour; of two leaves that only have each other the greater is folded. It gains w (1 - r K / 2m) by joining a community of the total K, so
    a node's leaves are folded only if it and all of them together leave a gain at the greatest resolution `most`.
    """
    degree = written(near.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"), F.count("*").alias("n"), F.min("b").alias("hub")))
    lone = degree.filter("n = 1").select(F.col("node").alias("leaf"), "hub", F.col("k").alias("w"))
    star = lone.groupBy("hub").agg(F.sum("w").alias("s"), F.min("leaf").alias("first"), F.count("*").alias("leaves"))
    star = star.join(degree.select(F.col("node").alias("hub"), "k", "n"), "hub").filter((F.lit(most) * (F.col("k") + F.col("s")) < two_m) & ((F.col("n") > 1) | (F.col("hub") < F.col("first"))))
    star = written(star.select("hub", "s"))
    leaves = written(lone.join(star.select("hub"), "hub", "left_semi").select("leaf", F.col("hub").alias("node"), "w"))
    stay = degree.join(leaves.select(F.col("leaf").alias("node")), "node", "left_anti").join(star.withColumnRenamed("hub", "node"), "node", "left")
    return written(stay.select("node", (F.col("k") + F.coalesce("s", F.lit(0.0))).alias("k"))), leaves


def leiden(graph: DataFrame, resolutions: dict[int, float] | None = None, tries: int = 3, moves: int = 8, merges: int = 3, rounds: int = 6, last: int = 4) -> DataFrame:
    """(level, node, community) of an undirected (u, v, weight) graph; a community is named by its least node.

    Every level is a resolution. Loops are left out and parallel edges summed; null ends are left out. Results do not depend on the layout. moves, merges,
    rounds and last bound the supersteps of a local move and a refinement, the aggregations, and the last moves; they end before that where nothing moves.
    """
    resolutions = resolutions or RESOLUTIONS
    tried = _tried(resolutions, tries)
    rate, level = _rate(tried), F.explode(F.array(*map(F.lit, sorted(tried))))
    sums = written(graph.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("weight").cast("double").alias("weight")))
    both = sums.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("w")).unionByName(sums.select(F.col("v").alias("a"), F.col("u").alias("b"), F.col("weight").alias("w")))
    two_m = 2 * (sums.agg(F.sum("weight")).first()[0] or 0.0)
    stay, leaves = folded(both, two_m, max(resolutions.values()))
    for end in ("u", "v"):
        sums = sums.join(leaves.select(F.col("leaf").alias(end)), end, "left_anti")
    sums = written(sums)
    both = sums.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("w")).unionByName(sums.select(F.col("v").alias("a"), F.col("u").alias("b"), F.col("weight").alias("w")))
    first = edges = written(both.withColumn("level", level))
    nodes = labels = written(stay.withColumn("level", level).select("level", "node", "k", F.col("node").alias("c"), F.lit(False).alias("moved")))
    where = labels.select("level", "node", F.col("node").alias("at"))
    step = 0

    def settle(labels: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, int]:
        nonlocal step
        any_, still = 0, 0
        for _ in range(most):
            labels, step = _step(edges, labels, rate, two_m, step, False), step + 1
            n = labels.filter("moved").count()
            any_, still = any_ + n, 0 if n else still + 1
            if still == 2:  # both halves had their turn
                break
        return labels, any_

    for _ in range(rounds):
        labels, moved = settle(labels, edges, moves)
        if moved:
            parts = labels.select("level", "node", "k", F.col("c").alias("home"), F.col("node").alias("c"))
            for _ in range(merges):
                parts, step = _step(edges, parts, rate, two_m, step, True).drop("moved"), step + 1
        else:
            parts = labels.select("level", "node", "k", F.col("c").alias("home"), "c")
            if parts.filter("node <> c").isEmpty():
                break
        name = parts.select("level", F.col("node").alias("at"), F.col("c").alias("part"))
        where = written(where.join(name, ["level", "at"]).select("level", "node", F.col("part").alias("at")))
        ends = [parts.select("level", F.col("node").alias(e), F.col("c").alias(f"{e}_")) for e in ("a", "b")]
        joined = edges.join(ends[0], ["level", "a"]).join(ends[1], ["level", "b"]).filter("a_ <> b_")
        edges = written(joined.groupBy("level", F.col("a_").alias("a"), F.col("b_").alias("b")).agg(F.sum("w").alias("w")))
        labels = written(parts.groupBy("level", F.col("c").alias("node")).agg(F.sum("k").alias("k"), F.first("home").alias("c")).withColumn("moved", F.lit(False)))
        labels = written(_named(labels))
    found = where.join(labels.select("level", F.col("node").alias("at"), "c"), ["level", "at"]).select("level", "node", "c")
    found, _ = settle(written(found.join(nodes.select("level", "node", "k"), ["level", "node"])), first, last)
    found = _whole(first, found.select("level", "node", "c"))
    if tries > 1:  # what is folded adds the same to all tries
        best = _modularity(sums.withColumnRenamed("weight", "w"), stay, two_m, found, tried).withColumn("of", F.floor(F.col("level") / tries).cast("int"))
        best = F.broadcast(best.groupBy("of").agg(F.max_by("level", F.struct("modularity", "level")).alias("level")))  # one row a level
        found = found.join(best, "level").select(F.col("of").alias("level"), "node", "community")
    return _unfolded(written(found), leaves)


def _unfolded(found: DataFrame, leaves: DataFrame) -> DataFrame:
    """(level, node, community) with the leaves, each in its node's community, and communities named by their least node."""
    # of a node's leaves the least alone can name a community
    least = leaves.groupBy("node").agg(F.min("leaf").alias("leaf"))
    names = found.join(least, "node", "left").groupBy("level", "community").agg(F.min(F.least("node", "leaf")).alias("name"))
    found = written(found.join(names, ["level", "community"]).select("level", "node", F.col("name").alias("community")))
    return found.unionByName(leaves.join(found, "node").select("level", F.col("leaf").alias("node"), "community"))


def _named(labels: DataFrame) -> DataFrame:
    """labels with communities named by their least node: a community's old name may be no node of the new graph, or one of another community."""
    low = labels.groupBy("level", "c").agg(F.min("node").alias("low"))
    return labels.join(low, ["level", "c"]).withColumn("c", F.col("low")).drop("low")


def _whole(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, node, community): labels split into connected pieces; the least name spreads along edges inside, and names jump."""
    ends = [labels.select("level", F.col("node").alias(e), F.col("c").alias(f"{e}_")) for e in ("a", "b")]
    inside = written(edges.join(ends[0], ["level", "a"]).join(ends[1], ["level", "b"]).filter("a_ = b_").select("level", "a", "b"))
    names = labels.select("level", "node", F.col("node").alias("community"))
    while True:
        near = inside.join(names.select("level", F.col("node").alias("b"), "community"), ["level", "b"]).groupBy("level", F.col("a").alias("node")).agg(F.min("community").alias("m"))
        low = names.join(near, ["level", "node"], "left").select("level", "node", F.least("community", F.coalesce("m", "community")).alias("c"), F.col("community").alias("old"))
        up = names.select("level", F.col("node").alias("c"), F.col("community").alias("y"))
        now = written(low.join(up, ["level", "c"], "left").select("level", "node", F.least("c", F.coalesce("y", "c")).alias("community"), "old"))
        names = now.select("level", "node", "community")
        if now.filter("community <> old").isEmpty():
            return names


def modularity(graph: DataFrame, communities: DataFrame, resolutions: dict[int, float] | None = None) -> DataFrame:
    """(level, modularity) of (level, node, community) over an undirected (u, v, weight) graph."""
    e = graph.filter("u <> v").select("u", "v", F.col("weight").cast("double").alias("w"))
    k = e.select(F.explode(F.array("u", "v")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))
    return _modularity(e, k, 2 * (e.agg(F.sum("w")).first()[0] or 0.0), communities, resolutions or RESOLUTIONS)


def _modularity(e: DataFrame, k: DataFrame, two_m: float, communities: DataFrame, resolutions: dict[int, float]) -> DataFrame:
    """(level, modularity) from edges (u, v, w) without loops and the nodes' (node, k)."""
    rate, at = _rate(resolutions), lambda end: communities.select("level", F.col("node").alias(end), F.col("community").alias(f"{end}_"))
    inner = e.join(at("u"), "u").join(at("v"), ["v", "level"]).filter("u_ = v_").groupBy("level").agg((2 * F.sum("w")).alias("x"))
    s = communities.join(k, "node").groupBy("level", "community").agg(F.sum("k").alias("s")).groupBy("level").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return s.join(inner, "level", "left").select("level", ((F.coalesce("x", F.lit(0.0)) - rate * F.col("ss") / two_m) / two_m).alias("modularity"))
