"""Nulls, empty tables, ties, repeats and odd input of the operators; and properties SQL does not show."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import catalog as C
from lodestack.operators import chunking as K
from lodestack.operators import conversation as D
from lodestack.operators import graph as G
from lodestack.operators import mutations as M
from lodestack.operators import quality as Q
from lodestack.operators import retrieval as R
from lodestack.operators import taxonomy as X


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, text string")


def test_bm25_edges(spark):
    d = docs(spark, (1, "wind wind sea"), (2, None), (3, ""), (4, "wind sun"), (5, "sun"), (5, "sun"))
    got = R.bm25(d, asked(spark, (1, "Wind wind"), (2, None), (3, "!"), (4, "zzz")), 10).collect()
    by = {q: [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3, 4)}
    assert by[1][0][0] == 1 and len(by[1]) == 6 and by[1][-1][1] == 0 and by[2] == by[3] == [] and [x[0] for x in by[4]] == [1, 2, 3, 4, 5, 5]
    assert R.bm25(d.limit(0), asked(spark, (1, "wind")), 3).count() == 0 and R.bm25(d, asked(spark).limit(0), 3).count() == 0


def test_cosine_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None), (7, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): (r["score"], r["rank"]) for r in R.cosine_neighbours(v, q, 10).collect()}
    assert got[9, 1] == (1.0, 1) and got[9, 4] == (1.0, 2) and got[9, 3][0] == 0 and got[9, 5][0] == 0 and (9, 2) not in got and all(k[0] != 8 for k in got) and got[7, 1][0] == 0
    with pytest.raises(Exception, match="dimension"):
        R.cosine_neighbours(v.filter("vec_id = 1").withColumn("embedding", F.array(F.lit(1.0))), q, 1).collect()
    assert R.cosine_neighbours(v.limit(0), q).count() == 0 and R.cosine_neighbours(v, q.limit(0)).count() == 0


def test_fusion_and_scoping(spark):
    ranked = lambda *r: spark.createDataFrame(list(r), "query_id long, doc_id long, score double, rank int")
    a, b = ranked((1, 1, 9.0, 1), (1, 2, 8.0, 2)), ranked((1, 2, 1.0, 1), (1, 3, 0.5, 2), (2, 7, 1.0, 1))
    got = {r["doc_id"]: r["score"] for r in R.rrf(a, b).filter("query_id = 1").collect()}
    assert got[2] == round(1 / 62 + 1 / 61, 9) and max(got, key=got.get) == 2
    with pytest.raises(ValueError):
        R.rrf(a, b, weights=(1.0,))
    assert {(r["query_id"], r["list"]) for r in R.first_available(a, b).collect()} == {(1, 0), (2, 1)}
    kept = R.doc_scope(b, spark.createDataFrame([(1, 3)], "query_id long, doc_id long")).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in kept} == {(1, 3, 1), (2, 7, 1)}
    aliases = spark.createDataFrame([("deep sea", "deepsea", None), ("deep sea 2", "deepsea 2", "deepsea")], "key string, alias string, hides string")
    titles = spark.createDataFrame([(1, "Deep Sea"), (2, "Deep Sea 2 notes")], "doc_id long, title string")
    found = R.alias_scope(asked(spark, (1, "what is DeepSea?"), (2, "and deepsea 2?"), (3, "deepseas")), aliases, titles).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} == {(1, 1), (1, 2), (2, 2)}
    assert R.route_label(F.lit("CROSS_document, or global")) is not None
    assert spark.range(1).select(R.route_label(F.lit("it is Global")), R.route_label(F.lit("?"))).first()[:] == ("global", "entity")


def test_where(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x long, y string")
    n = lambda f: df.filter(Q.where(f, df.columns)).count()
    assert [n({}), n({"y": "a"}), n({"y": {"$ne": "a"}}), n({"x": {"$in": []}}), n({"zz": 1}), n({"$or": [{"x": 1}, {"y": "b"}]}), n({"$and": [{"x": {"$in": [1, 2]}}, {"y": {"$eq": "b"}}]})] == [3, 1, 2, 0, 3, 2, 1]


def test_quality_edges(spark):
    rows = [("1", "12\nshort"), ("2", "$$x$$"), ("3", None), ("4", "word " * 40), ("5", "Page 3 of 9 " + " " * 3), ("6", "[1] A title of 2001, see https://example.org/x and more words to be long enough for the check"), ("7", "1 + 2 = 3 4 5 6 7 8 9 " * 10)]
    got = {r["chunk_id"]: r["reason"] for r in Q.quality_reason(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert got == {"1": "too_short", "2": None, "3": "too_short", "4": None, "5": "too_short", "6": "single_citation", "7": "low_alpha_ratio"}
    refs = spark.createDataFrame([("word " * 40, " 7 References ")], "text string, section string")
    assert Q.quality_reason(refs).first()["reason"] == "references_section"
    c = spark.createDataFrame([(1, 0, "\tx "), (1, 1, "x"), (1, 2, " x"), (1, 3, None), (2, 0, "x")], "doc_id long, chunk_index int, text string")
    assert sorted((r["doc_id"], r["chunk_index"], r["text"] or "") for r in Q.dedupe_chunks(c).collect()) == [(1, 0, "\tx "), (1, 3, ""), (2, 0, "x")]


def test_chunks_cover_the_text(spark):
    r = random.Random(4)
    text = "\n\n".join([f"# Part {i}\n\n" + "\n\n".join(" ".join(r.choices("wind sea sun moon tide".split(), k=r.randint(1, 300))) for _ in range(4)) for i in range(5)])
    d = spark.createDataFrame([("a", text, "u", "T"), ("b", None, "u", "T"), ("c", " \n", "u", "T"), ("d", "$$a\n\nb$$", "u", None)], "doc_id string, text string, user_id string, title string")
    got = K.chunk_documents(d, 60, 10).orderBy("doc_id", "chunk_index").collect()
    mine = [g for g in got if g["doc_id"] == "a"]
    assert [g["chunk_index"] for g in mine] == list(range(len(mine))) and all(f"[T] [Part {i}]" in "".join(g["embedding_text"] for g in mine) for i in range(5))
    said = "\n".join(g["text"] for g in mine)
    assert all(p.strip() in said for p in text.split("\n") if p.strip() and len(p) <= 240)
    assert {g["doc_id"] for g in got} == {"a", "d"} and [g["text"] for g in got if g["doc_id"] == "d"] == ["$$a\n\nb$$"] and got[-1]["has_math"]
    spans = K.section_spans(d.select("doc_id", "text")).filter("doc_id = 'a'").orderBy("start").collect()
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(text) and all(a["end"] == b["start"] for a, b in zip(spans, spans[1:]))


def test_memory_texts(spark):
    f = spark.createDataFrame([("a.md", "x\n# One\ny\n## Two\nz"), ("b.txt", "p\n\n q \n"), ("c.txt", None)], "path string, text string")
    assert {(r["path"], r["text"]) for r in K.memory_texts(f).collect()} == {("a.md", "x"), ("a.md", "One\ny"), ("a.md", "Two\nz"), ("b.txt", "p"), ("b.txt", "q")}


def test_headings_and_math(spark):
    h = lambda s: spark.range(1).select(T.heading_label(F.lit(s))).first()[0]
    assert [h("## 2.1. Methods:"), h("IV. Results —"), h("12"), h("x" * 81), h("a�b"), h("  A   b ")] == ["Methods", "Results", "", "", "", "A b"]
    m = lambda s: spark.range(1).select(T.has_math(F.lit(s).cast("string"))).first()[0]
    assert [m("$x$"), m(r"\(a\)"), m("costs $5 and $$"), m("α and ∑"), m("α only"), m("a=b and c=d with f(x)"), m(None)] == [True, True, False, True, False, True, False]


def test_intents(spark):
    cases = {"": "unclear", "?!": "unclear", "what is my name": "personal", "so what's up": "greeting", "heeey": "greeting", "thanks!": "greeting", "What is a tide?": "factual", "well, explain tides": "factual", "what is me": None, "tides and moons please": None}
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", D.intent(F.col("q"))["intent"].alias("i")).collect()
    assert {r["q"]: r["i"] for r in rows} == cases


def test_parts_and_target(spark):
    c = spark.createDataFrame([(1, i, "# Tides" if i == 3 else None) for i in range(23)] + [(2, 0, None)], "doc_id long, chunk_index int, section string")
    p = D.parts(c).filter("doc_id = 1").orderBy("part").collect()
    assert [(x["first"], x["last"]) for x in p] == [(round(23 * i / 10), round(23 * (i + 1) / 10) - 1) for i in range(10)] and p[1]["label"] == "Tides" and p[0]["label"] == "Part 1"
    hits = spark.createDataFrame([(1, 5, "document", 0.1, None), (1, 6, "document", 0.1, 0.9), (1, 7, "episodic", 9.0, 9.0)], "query_id long, doc_id long, source_type string, score double, rerank double")
    assert D.target_document(hits).first()["doc_id"] == 6


def test_page_rank_properties(spark):
    line = spark.createDataFrame([("a", "x", "b", 1.0), ("b", "x", "c", 1.0), ("b", "x", "c", 1.0)], "src string, relation string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "a", 1.0), (2, "zzz", 1.0)], "query_id long, node string, weight double")
    got = {r["node"]: r["score"] for r in G.page_rank(line, seeds).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["a"] > got["b"] > got["c"]
    assert {r["node"]: r["score"] for r in G.page_rank(line, seeds, damping=0.0).collect()}["a"] == 1.0
    joins = {r["node"]: r["score"] for r in G.page_rank(line, seeds, nodes_limit=0).collect()}
    assert all(abs(joins[k] - got[k]) < 1e-5 for k in got)
    with pytest.raises(ValueError):
        G.page_rank(line, seeds, damping=1.5)
    with pytest.raises(ValueError):
        G.page_rank(line, seeds.withColumn("weight", F.lit(-1.0)))


def test_graph_edges(spark):
    t = spark.createDataFrame([("c1", "A", "likes", "B"), ("c2", "a ", "Likes", "b"), ("c2", None, "x", "y"), ("c3", "a", "likes", "a"), ("c3", "b", "of", "c"), ("c3", "z" * 201, "sees", "b")], "chunk_id string, head string, relation string, tail string")
    assert [r["reason"] for r in G.triple_reason(t).orderBy("chunk_id", F.length("head")).collect()].count(None) == 2
    e = G.edges(t).collect()
    assert len(e) == 1 and e[0]["chunks"] == ["c1", "c2"]
    left = G.delete_support(G.edges(t), spark.createDataFrame([("c1",)], "chunk_id string"))
    assert left.first()["chunks"] == ["c2"] and G.delete_support(left, spark.createDataFrame([("c2",)], "chunk_id string")).count() == 0
    two = spark.createDataFrame([(a, "r", b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "r", "w", 1.0)], "src string, relation string, dst string, weight double")
    parts = {(r["level"], r["community"]) for r in G.communities(two).collect()}
    assert {c for l, c in parts if l == 1} == {"a", "w"}
    assert {r["component"] for r in G.components(two).collect()} == {"a"} and G.degrees(t.limit(0).select(F.col("head").alias("src"), F.col("tail").alias("dst"))).count() == 0
    p = spark.createDataFrame([("cat", 1, [1.0, 0.0]), ("cats", 2, [0.99, 0.1]), ("car", 3, [0.0, 1.0])], "phrase string, place int, embedding array<double>")
    assert {r["phrase"]: r["leader"] for r in G.merge_synonyms(p).collect()} == {"cat": "cat", "cats": "cat", "car": "car"}


def test_organise(spark):
    rows = [(1, 1, 0.9, ["a", "b"]), (1, 2, 0.8, ["a", "b"]), (1, 3, 0.7, ["b", "c", "d", "e"]), (1, 4, 0.6, ["z"]), (2, 5, 0.5, None)]
    got = R.organise(spark.createDataFrame(rows, "query_id long, doc_id long, score double, names array<string>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 1), (1, 3), (1, 4), (2, 5)]


def test_tree_edits(spark):
    n = spark.createDataFrame([("root", None, "root", 0, False), ("a", "root", "a", 1, False), ("b", "a", "b", 2, True), ("c", "root", "c", 1, True)], "node_id string, parent_id string, label string, depth int, is_leaf boolean")
    moved = {r["node_id"]: (r["parent_id"], r["depth"], r["is_leaf"]) for r in X.move(n, "a", "c").collect()}
    assert moved["a"] == ("c", 2, False) and moved["b"] == ("a", 3, True) and moved["c"][2] is False
    with pytest.raises(ValueError):
        X.move(n, "a", "b")
    f = spark.createDataFrame([("u", "d1", "b", 1.0, True), ("u", "d2", "c", 1.0, True)], "user_id string, doc_id string, node_id string, score double, is_primary boolean")
    nodes, filed = X.remove(n, f, "a", "c")
    assert {r["node_id"] for r in nodes.collect()} == {"root", "c"} and filed.filter("node_id = 'c'").count() == 2
    leaves = spark.createDataFrame([(1, "b", 0.9), (1, "c", 0.5)], "query_id long, node_id string, score double")
    assert [r["node_id"] for r in X.capped_leaves(leaves, f, 0.5).collect()] == ["b"] and X.capped_leaves(leaves.limit(0), f).count() == 0


def test_built_tree(spark):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([("u", f"d{i}", [float(x) for x in r.normal(size=4) + 9 * np.eye(4)[i % 4]]) for i in range(40)] + [("u", "none", None)], "user_id string, doc_id string, embedding array<double>")
    nodes, filed = X.build_tree(v, 4, 1)
    assert filed.count() == 40 and filed.join(nodes.filter("is_leaf"), "node_id", "left_anti").count() == 0


def test_mutations(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (None, "m"), (3, "e")], "k long, v string")
    assert sorted(map(str, [tuple(r) for r in M.upsert(t, new, "k").collect()])) == sorted(map(str, [(1, "a"), (2, "d"), (None, "m"), (3, "e")]))
    assert M.upsert(t.limit(0), new.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        M.check_dimension(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2)


def test_percentiles_narrow_exactly(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(x)) for x in r.normal(size=3001)] + [("b", 5.0)] * 10 + [("c", None)]
    got = {x["k"]: x for x in C.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95}, limit=100).collect()}
    a = [v for k, v in rows if k == "a"]
    assert got["a"]["p50"] == round(float(np.quantile(a, 0.5)), 6) and got["a"]["p95"] == round(float(np.quantile(a, 0.95)), 6) and got["b"]["p95"] == 5.0 and "c" not in got
    assert C.exact_percentiles(spark.createDataFrame([], "k string, v double"), "k", "v", {"p50": 0.5}).count() == 0


def test_history(spark):
    c = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 1, "user", "x"), (2, 2, "assistant", None), (3, 1, "user", "only")], "conv_id long, turn long, role string, text string")
    assert {(r["conv_id"], r["turn"], r["back"]) for r in C.recent_messages(c, 6).collect()} == {(1, 2, 1), (1, 1, 2), (2, 2, 1), (2, 1, 2)}
