"""Whole retrievals over a frame of questions: the graph as a retriever, communities as a retriever, and a turn as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capital_runs
from ..providers import Embedder
from ..providers import embed as embed_texts
from ..sources.tables import written
from . import graph as G
from . import planning as L
from . import retrieval as R


def question_names(questions: DataFrame) -> DataFrame:
    """(query_id, place, name): the names that questions (query_id, text) hold, by the pattern of capitalised runs."""
    return questions.select("query_id", F.posexplode(capital_runs(F.col("text"))).alias("place", "name"))


def near_phrases(names: DataFrame, nodes: DataFrame, embedder: Embedder, k: int = 3) -> DataFrame:
    """(query_id, node, score): for each name of a question the k phrase nodes (node) of the best cosine above 0; each distinct name is searched once."""
    # written, else the filter on embeddings moves below distinct() and every repeat is embedded
    asked = embed_texts(written(names.select(F.col("name").alias("query_id"), F.col("name").alias("text")).distinct()), embedder)
    found = R.cosine_neighbours(embed_texts(written(nodes.select("node", F.col("node").alias("text")).distinct()), embedder), asked, k, "node").filter("score > 0")
    return names.select("query_id", "name").distinct().join(found.withColumnRenamed("query_id", "name"), "name").groupBy("query_id", "node").agg(F.max("score").alias("score"))


def graph_retrieve(questions: DataFrame, phrases: DataFrame, contains: DataFrame, chunks: DataFrame, embedder: Embedder | None = None, k: int = 10, near: int = 3, damping: float = 0.5, alpha: float = 0.5, **walk) -> DataFrame:
    """(query_id, chunk_id, score, rank, and chunks' other columns) of (query_id, text) questions, through the graph.

    Names of a question are matched with phrase nodes exactly (weight 1) and, with an embedder, to the `near` most alike (weight: the cosine); these seeds
    are walked over phrase edges and contains edges; a passage scores alpha of its own rank and the rest from the phrases that name it. Chunks that are
    gone (not among chunks) are dropped before the ranking is cut. A question without a known name has no row; nulls are no names.
    """
    nodes = written(phrases.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(contains.select(F.col("src").alias("node"))).distinct())
    names = written(question_names(questions))
    exact = G.find_phrases(nodes, names)
    seeds = written(G.seed_weights(exact, near_phrases(names, nodes, embedder, near) if embedder is not None else exact.select("query_id", "node", F.lit(0.0).alias("score"))))
    live = contains.join(chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_semi")
    edges = phrases.select("src", "dst", "weight").unionByName(contains.select("src", "dst", "weight"))
    ranks = written(G.page_rank(edges, seeds, damping, **walk))
    found = G.passage_scores(ranks, live, k, alpha)
    more = [c for c in chunks.columns if c not in ("query_id", "chunk_id", "score", "rank")]
    return found.join(chunks.select("chunk_id", *more), "chunk_id").select("query_id", "chunk_id", "score", "rank", *more)


def community_summaries(members: DataFrame, contains: DataFrame, chunks: DataFrame, most: int = 12, longest: int = 800) -> DataFrame:
    """(community_id, level, members, text) of communities (level, community, node) with at least two chunks: what a model is to sum up.

    members are the chunks that name the community's phrases; text is its shortest passages, `most` of them, each cut at `longest` characters, a blank line between.
    """
    rows = written(L.community_chunks(members, contains).select("level", "community", F.explode("chunks").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id"))
    w = Window.partitionBy("level", "community").orderBy(F.length("text"), "chunk_id")
    best = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    text = best.groupBy("level", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, longest).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    all_ = rows.groupBy("level", "community").agg(F.array_sort(F.collect_set("chunk_id")).alias("members"))
    return all_.join(text, ["level", "community"]).select(F.concat(F.lit("l"), F.col("level").cast("string"), F.lit("_"), F.col("community").cast("string")).alias("community_id"), "level", "members", "text")


def community_retrieve(questions: DataFrame, summaries: DataFrame, embedder: Embedder, k: int = 5, levels: list[int] | None = None) -> DataFrame:
    """planning.community_search of (query_id, text) questions over summaries (community_summaries), both embedded."""
    return L.community_search(embed_texts(summaries, embedder), embed_texts(questions.select("query_id", "text"), embedder).select("query_id", "embedding"), k, levels)


def turn(questions: DataFrame, lists: dict[str, DataFrame], kinds: DataFrame, ema: DataFrame | None = None, again: DataFrame | None = None, least: float = 0.1, retry: float = 0.05, swap: float = 0.15, k: int = 20) -> DataFrame:
    """(query_id, intent, doc_id, source_type, score, rank, fallback): what each question of a frame gets to read, in one plan without a loop over questions.

    questions (query_id, intent, route); lists: rankings (query_id, doc_id, score, rank) by retriever; kinds (doc_id, source_type).
    1. policy: intents that skip retrieval have no row; others get their source types and final rows (planning.plan). 2. The route picks or fuses
    lists. 3. Rows of other source types go. 4. Scores are cut at `least`, with the fallback on the first rows. 5. Feedback nudges. 6. Where the best is
    below `retry`, the rows of `again`, a ranking of rephrased questions, take over. 7. Factual questions whose best is below `swap` become general and keep their rows
    as general ones. 8. Memories come first; the policy's final rows remain. Ties by id.
    """
    plan = L.plan(questions.select("query_id", "intent", "route")).filter("final_k is not null")
    ranked = R.route(plan.select("query_id", "route"), {n: d.select("query_id", "doc_id", "score", "rank") for n, d in lists.items()}, k).drop("route")

    def allowed(rows: DataFrame) -> DataFrame:
        typed = rows.join(kinds, "doc_id").join(plan.select("query_id", "source_types"), "query_id")
        return typed.filter(F.col("source_types").isNull() | F.array_contains("source_types", F.col("source_type"))).drop("source_types")

    kept = R.threshold(allowed(ranked).withColumnRenamed("score", "rerank"), least, k)
    kept = R.nudge(kept, ema) if ema is not None else kept.withColumn("score", F.col("rerank"))
    kept = written(kept.select("query_id", "doc_id", "source_type", "score", "rank", "fallback"))
    if again is not None:
        fresh = allowed(again.select("query_id", "doc_id", "score", "rank")).withColumn("fallback", F.lit(False))
        kept = written(R.retry_below(kept, fresh.select(*kept.columns), retry))
    intents = L.swap_to_general(plan.select("query_id", "intent", "final_k"), kept, swap)
    rows = R.episodic_first(kept).join(intents, "query_id").filter(F.col("rank") <= F.col("final_k"))
    return rows.select("query_id", "intent", "doc_id", "source_type", "score", "rank", "fallback")
