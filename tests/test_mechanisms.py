"""Session state with timers, document files as a data source, table functions, centroids kept up to date, and rules that were wrong once."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import tables as TF
from lodestack.operators import catalog as C
from lodestack.operators import chunking as K
from lodestack.operators import conversation as D
from lodestack.operators import taxonomy as X
from lodestack.providers import hash_embedding
from lodestack.sources import files as SF
from lodestack.streaming import sessions as SS

MESSAGES = "session_id long, message_id long, content string, ts timestamp"


def talk(n=70):
    r, t = random.Random(2), dt.datetime(2024, 1, 1)
    names = ["Ada Lovelace", "Zürich", "Mars", "the tide", "wind and sea", "Oslo"]
    return [(i % 4, i, None if i % 17 == 5 else " ".join(r.choices(names, k=r.randint(1, 4))), t + dt.timedelta(minutes=i)) for i in range(n)]


def test_session_state_equals_the_batch_operators(spark, tmp_path):
    rows, later = talk(), dt.datetime(2024, 1, 3)
    order = iter(range(9))

    def add(part):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"{next(order)}"))

    def run():
        src = spark.readStream.schema(MESSAGES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = SS.closing_sessions(src, "30 minutes", "1 minute", most=4, keep=3, longer=6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    (tmp_path / "in").mkdir()
    add(rows[:23])
    run()
    add(rows[23:50])
    run()  # goes on from the checkpoint
    add(rows[50:])
    add([(99, 1000, "Late Sentinel", later)])
    run()
    add([(98, 1001, "x", later + dt.timedelta(days=1))])
    run()
    got = {r["session_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) >= {0, 1, 2, 3}
    batch = spark.createDataFrame(rows, MESSAGES)
    names = {}
    for r in D.tracked_entities(batch, 4).collect():
        names.setdefault(r["session_id"], set()).add(r["name"])
    groups = {}
    for r in D.compact(batch, keep=3, longer=6).orderBy("cluster").collect():
        groups.setdefault(r["session_id"], []).append(list(r["message_ids"]))
    for s in range(4):
        assert set(got[s]["names"]) == names[s] and [list(c) for c in got[s]["clusters"]] == groups[s] and got[s]["n_messages"] == sum(x[0] == s for x in rows)


def test_clusters_follow_the_normalised_mean(spark):
    rows = talk(60)
    got = {(r["session_id"], r["cluster"]): list(r["message_ids"]) for r in D.compact(spark.createDataFrame(rows, MESSAGES)).collect()}
    want = {}
    for s in range(4):
        old, means, members = [r for r in rows if r[0] == s][:-6], [], []
        for _, i, text, _ in old:
            v = hash_embedding(text or "", 256)
            sims = [float(v @ m) for m in means]
            j = int(np.argmax(sims)) if sims else -1
            if j >= 0 and sims[j] > 0.55:
                n = len(members[j])
                m = (means[j] * n + v) / (n + 1)
                means[j] = m / np.linalg.norm(m)
                members[j].append(i)
            else:
                means.append(v)
                members.append([i])
        want |= {(s, j): m for j, m in enumerate(members)}
    assert got == want


def test_files_in_batch_and_stream(spark, tmp_path):
    SF.register(spark)
    d = tmp_path / "docs"
    (d / "deep").mkdir(parents=True)
    (d / "a.txt").write_text("wind")
    (d / "deep" / "b.MD").write_bytes(b"# tide \xff")
    (d / "c.docx").write_bytes(b"not a zip file")
    (d / "e.txt").write_text("")
    (d / "left.out").write_text("no")
    (d / "large.txt").write_text("x" * 5000)
    (d / "large.txt").chmod(0)
    read = lambda r: r.format("document_files").option("largest", 1000).option("bytes", 8).option("settle", 0).load(str(d))
    batch = read(spark.read)
    rows = {r["title"]: r for r in batch.collect()}
    assert set(rows) == {"a", "b", "c", "e"} and rows["a"]["text"] == "wind" and rows["b"]["text"] == "# tide �" and rows["c"]["text"] is None and "BadZipFile" in rows["c"]["error"] and rows["e"]["text"] == ""
    assert batch.rdd.getNumPartitions() > 1 and read(spark.read).filter("kind = 'md'").count() == 1

    def run():
        q = read(spark.readStream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run()
    time.sleep(0.02)
    (d / "new.txt").write_text("sea")
    run()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.select(*SF.SCHEMA.replace(",", "").split()[::2]).collect()))
    assert key(streamed) == key(read(spark.read))
    assert spark.read.format("document_files").load(str(tmp_path / "none")).count() == 0


def test_table_functions_equal_the_operators(spark):
    assert TF.register(spark) == ["text_chunks", "document_sections", "beam_level"]
    r = random.Random(9)
    lines = ["# Tides", "## Of the moon", "2.1 Methods of work", "3. Ending here", "A LINE IN CAPITALS", "plain words of text", "", "  more words  "]
    docs = spark.createDataFrame([(i, "\n".join(r.choices(lines, k=r.randint(1, 12)))) for i in range(30)] + [(40, None), (41, ""), (42, " \n ")], "doc_id long, text string")
    docs.createOrReplaceTempView("docs")
    K.document_lines(docs).createOrReplaceTempView("doc_lines")
    got = spark.sql("SELECT * FROM document_sections(TABLE(SELECT doc_id, line_no, line FROM doc_lines))")
    assert sorted(map(str, got.collect())) == sorted(map(str, K.section_spans(docs).select(*got.columns).collect()))
    got = {(x["doc_id"], x["chunk_index"]): x["text"] for x in spark.sql("SELECT doc_id, c.* FROM docs, LATERAL text_chunks(text, 5, 1) c").collect()}
    want = {(x["doc_id"], i): c for x in docs.collect() if (x["text"] or "").strip() for i, c in enumerate(K.pack(K.paragraphs(x["text"]), 5, 1))}
    assert got == want
    with pytest.raises(Exception, match="missing columns"):
        spark.sql("SELECT * FROM document_sections(TABLE(SELECT doc_id FROM docs))").collect()
    tree = spark.createDataFrame([("root", None, "r", 0, False, None), *[(f"l{i}", "root", f"l{i}", 1, True, [r.uniform(-1, 1) for _ in range(4)]) for i in range(9)]], "node_id string, parent_id string, label string, depth int, is_leaf boolean, centroid array<double>")
    asked = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(12)], "query_id long, embedding array<double>")
    for law in ((3, 0.05, 0.3, 0.1), (2, -2.0, -2.0, 0.0), (5, 0.4, 0.9, 0.5)):
        trace = X.beam_descend(asked, tree, *law)
        trace.withColumn("label", F.col("node_id")).createOrReplaceTempView("scored")
        got = spark.sql(f"SELECT * FROM beam_level(TABLE(scored), {', '.join(map(str, law))})")
        assert {(x["query_id"], x["node_id"], x["kept"]) for x in got.collect()} == {(x["query_id"], x["node_id"], x["kept"]) for x in trace.collect()}


def test_a_node_without_centroid_scores_zero(spark):
    tree = spark.createDataFrame([("root", None, "r", 0, False, None), ("a", "root", "a", 1, True, [-1.0, 0.0]), ("b", "root", "b", 1, True, None), ("c", "root", "c", 1, True, [0.0, 1.0])], "node_id string, parent_id string, label string, depth int, is_leaf boolean, centroid array<double>")
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.1]), (3, [0.6, 0.8])], "doc_id long, embedding array<double>")
    got = {(r["doc_id"], r["is_primary"]): (r["node_id"], r["tied"]) for r in X.assign(docs, tree, second=True).collect()}
    assert got[1, True] == ("b", True) and got[1, False][0] == "c" and got[2, True] == ("a", False) and got[3, True] == ("c", False) and (3, False) not in got and (2, False) not in got


def test_centroids_kept_up_to_date(spark):
    r = random.Random(4)
    nodes = spark.createDataFrame([("root", None, "root", 0, False), ("p", "root", "p", 1, False), ("q", "root", "q", 1, False), *[(f"l{i}", "p" if i < 3 else "q", f"l{i}", 2, True) for i in range(6)]], "node_id string, parent_id string, label string, depth int, is_leaf boolean")
    vectors = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(5)] if i % 11 else None) for i in range(80)], "doc_id long, embedding array<double>")
    filed = lambda pairs: spark.createDataFrame(sorted(pairs), "node_id string, doc_id long")
    now = {(f"l{i % 5}", i) for i in range(40)}
    state = X.state_of(filed(now), vectors)
    full = lambda: X.tree_centroids(nodes, X.mean_vectors(filed(now).join(vectors, "doc_id"), "node_id"))
    tree = full()
    for step in range(3):
        gone = set(r.sample(sorted(now), 12)) | ({x for x in now if x[0] == "l2"} if step == 1 else set())
        new = {(f"l{r.randint(0, 5)}", i) for i in range(40 + 10 * step, 50 + 10 * step)}
        now = now - gone | new
        state = X.merged(state, X.state_of(filed(new), vectors), X.state_of(filed(gone), vectors))
        tree = X.refreshed(tree, state, filed(new | gone).select("node_id"))
        flat = lambda t: {x["node_id"]: (x["doc_count"], x["centroid"] and [round(v, 9) for v in x["centroid"]]) for x in t.collect()}
        assert flat(tree) == flat(full())


def test_topics_are_letters_of_titles(spark):
    docs = spark.createDataFrame([("u", "Report 2023: Priority1 of the Tides_and-Moons"), ("u", None)], "user_id string, title string")
    assert {r["term"] for r in D.topic_terms(docs).collect()} == {"report", "priority", "tides", "moons"}
    q = spark.createDataFrame([(1, "u", "what of Priority and 2023?"), (2, "u", "priority1 tides_and"), (3, "v", "tides"), (4, "u", None)], "query_id long, user_id string, text string")
    assert {(r["query_id"], tuple(r["topics"])) for r in D.known_topics(q, D.topic_terms(docs)).collect()} == {(1, ("priority",))}


def test_a_null_key_has_percentiles(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), (None, None)], "k string, v double")
    for limit in (1 << 20, 1):
        got = {r["k"]: (r["m"], r["n"]) for r in C.exact_percentiles(d, "k", "v", {"m": 0.5}, limit=limit).collect()}
        assert got == {"a": (2.0, 2), None: (6.0, 2)}
