"""Replies that are cut anywhere, invented documents, deep trees, overflow; progress events in order and not too often; the turn's edges."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.operators import replies as P
from lodestack.operators import turn as T
from lodestack.providers import HashEmbedder
from lodestack.streaming.progress import ProgressTable, cancel

TREE = {"tree": {"label": "all", "children": [{"label": "Sea \"and\" {wind}", "description": "a, b] c", "keywords": ["sea ", ""], "children": [{"label": "", "doc_ids": ["1", "2", "x"]}, {"label": "empty"}]}, {"label": "Moon", "doc_ids": ["2", 3, None, "4"]}]}}


def part_of(a, b):
    """Whether a is b with members and items missing."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in b and part_of(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) <= len(b) and all(part_of(x, y) for x, y in zip(a, b))
    return a == b


@pytest.mark.parametrize("indent", [None, 1])
def test_every_cut_gives_a_part(indent):
    whole, seen = json.dumps(TREE, indent=indent), 0
    for n in range(len(whole) + 1):
        got = P.repaired("```json\n" + whole[:n])
        assert (got is None) == (n == 0) and (got is None or part_of(got, TREE)), n
        docs = len(json.dumps(got or {}))
        assert docs >= seen - 30
        seen = max(seen, docs)
    assert P.repaired(f"Sure! ```json\n{whole}\n``` and {{more}}") == TREE


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12), st.data())
def test_cuts_of_any_json(value, data):
    whole = json.dumps({"v": value})
    got = P.repaired(whole[:data.draw(st.integers(0, len(whole)))])
    numbers = lambda a, b: part_of(a, b) or any(c.isdigit() for c in whole)
    assert got is None or numbers(got, {"v": value})
    assert P.repaired(whole) == {"v": value}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from('{}[]",:\\ab1 \n'), max_size=30))
def test_any_text_is_read(text):
    got = P.repaired(text)
    assert got is None or isinstance(got, dict)
    assert P.tree_of(text)[0][0] == "root"


def test_trees_and_filings(spark):
    replies = spark.createDataFrame([(1, json.dumps(TREE)), (2, None), (3, "[]"), (4, json.dumps(TREE)[:-40])], "tree_id int, reply string")
    docs = spark.createDataFrame([(i,) for i in range(1, 8)] + [(None,)], "doc_id long")
    nodes, filings = P.tree_from_reply(replies, docs)
    got = {(r["tree_id"], r["node_id"]): (r["parent_id"], r["label"], r["is_leaf"], r["keywords"]) for r in nodes.collect()}
    assert got[1, "root.0"] == ("root", 'Sea "and" {wind}', False, ["sea"]) and got[1, "root.0.0"] == ("root.0", "Unnamed", True, []) and (1, "root.0.1") not in got
    assert got[2, "root"][2] and got[3, "root"][2] and not got[1, "root"][2] and {k for k in got if k[0] == 4} == {(4, "root"), (4, "root.0"), (4, "root.0.0")}
    assert {tuple(r)[:3] + (r["is_primary"],) for r in filings.filter("tree_id = 1").collect()} == {(1, 1, "root.0.0", True), (1, 2, "root.0.0", True), (1, 2, "root.1", False), (1, 4, "root.1", True)}
    flat, filed = P.tree_from_reply(replies.filter("tree_id = 1"), docs, 1)
    assert {r["node_id"] for r in flat.collect()} == {"root", "root.0", "root.1"} and filed.filter("node_id = 'root.0'").count() == 2
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (4, [0.0, 1.0]), (5, [0.1, 1.0]), (6, [1.0, 0.2]), (7, None)], "doc_id long, embedding array<double>")
    out = {(r["doc_id"], r["node_id"]) for r in P.file_overflow(nodes.filter("tree_id = 1").drop("tree_id"), filings.filter("tree_id = 1"), vectors).collect()}
    assert (5, "root.1") in out and (6, "root.0.0") in out and all(d != 7 for d, _ in out)
    assert P.tree_from_reply(replies.limit(0), docs)[0].count() == 0


def test_progress_is_ordered_and_rate_limited(spark, tmp_path):
    path, every = str(tmp_path / "progress"), 1.5
    table = ProgressTable(spark, path, every)
    spark.streams.addListener(table)
    try:
        for n in range(6):
            spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        for _ in range(100):
            if table.writes and table.read().filter("kind = 'ended'").count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(table)
    rows = table.read().orderBy("seq").collect()
    kinds, batches = [r["kind"] for r in rows], [r["batch"] for r in rows if r["kind"] == "progress"]
    assert kinds[0] == "started" and kinds[-1] == "ended" and batches == sorted(set(batches)) and batches[-1] == 5
    assert len(batches) + table.skipped == table.seq - 2 and all(b - a >= every - 0.01 for a, b in zip(table.writes, table.writes[1:-1]))


def test_cancel_leaves_no_half_batch(spark, tmp_path):
    (tmp_path / "out" / "batch=0").mkdir(parents=True)
    (tmp_path / "out" / "batch=0" / "_SUCCESS").touch()
    (tmp_path / "out" / "batch=1" / "_temporary").mkdir(parents=True)
    spark.range(3).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
    cancel(spark, q, "ingest", str(tmp_path / "out"))
    assert not q.isActive and [p.name for p in (tmp_path / "out").iterdir()] == ["batch=0"]


def test_graph_retrieval_edges(spark):
    phrases = spark.createDataFrame([("ada", "knows", "mars", 1.0)], "src string, relation string, dst string, weight double")
    contains = spark.createDataFrame([("ada", "c1", 1.0), ("mars", "c2", 1.0), ("ada", "gone", 1.0)], "src string, dst string, weight double")
    chunks = spark.createDataFrame([("c1", "x", 9), ("c2", "y", 9)], "chunk_id string, text string, rank int")
    q = spark.createDataFrame([(1, "who is Ada?"), (2, "nobody"), (3, None), (4, "Ada and Ada again")], "query_id long, text string")
    for embedder in (None, HashEmbedder(64)):
        got = {(r["query_id"], r["chunk_id"]): r["rank"] for r in T.graph_retrieve(q, phrases, contains, chunks, embedder).collect()}
        assert got[1, "c1"] == 1 and got[4, "c1"] == 1 and {k[0] for k in got} == {1, 4} and all(k[1] != "gone" for k in got)
    members = spark.createDataFrame([(0, "a", "ada"), (0, "a", "mars"), (1, "b", "ada")], "level int, community string, node string")
    s = T.community_summaries(members, contains, chunks).collect()
    assert [(r["community_id"], r["members"], r["text"]) for r in s] == [("l0_a", ["c1", "c2"], "x\n\ny")] or {r["community_id"] for r in s} == {"l0_a", "l1_b"}
    found = T.community_retrieve(q, T.community_summaries(members, contains, chunks), HashEmbedder(64), 2)
    assert found.filter("chunk_id = 'community::l0_a'").count() >= 1


def test_turn_edges(spark):
    ranked = lambda *r: spark.createDataFrame(list(r), "query_id long, doc_id long, score double, rank int")
    q = spark.createDataFrame([(1, "factual", "entity"), (2, "greeting", "entity"), (3, "odd", "global"), (4, "personal", "entity")], "query_id long, intent string, route string")
    kinds = spark.createDataFrame([(i, "episodic" if i == 3 else "web" if i == 4 else "document") for i in range(1, 6)], "doc_id long, source_type string")
    dense = ranked((1, 1, 0.9, 1), (1, 3, 0.8, 2), (1, 2, 0.01, 3), (2, 1, 0.9, 1), (4, 4, 0.9, 1), (4, 5, 0.5, 2))
    got = {(r["query_id"], r["doc_id"]): (r["rank"], r["intent"], r["fallback"]) for r in T.turn(q, {"vector": dense, "bm25": ranked()}, kinds).collect()}
    assert got == {(1, 3): (1, "factual", False), (1, 1): (2, "factual", False), (4, 5): (1, "personal", False)}
    weak = {(r["query_id"], r["doc_id"]): r["intent"] for r in T.turn(q, {"vector": ranked((1, 1, 0.01, 1))}, kinds, again=ranked((1, 2, 0.1, 1), (3, 1, 0.3, 1))).collect()}
    assert weak == {(1, 2): "general", (3, 1): "odd"}
