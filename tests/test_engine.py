import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestack.__main__ import main
from lodestack.config import load_config
from lodestack.engine import Engine
from lodestack.functions.register import register
from lodestack.providers import EchoModel, complete_once, grade, json_list
from lodestack.sources.loaders import load_document, load_folder
from lodestack.sources.store import Vectors, load_graph, save_graph

LONG = "Solar panels turn light into current. " * 12


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def test_ingest_search_forget_delete(spark, engine):
    docs = spark.createDataFrame([("d1", "u", "Sun", "document", f"# Light\n\n{LONG}\n\n{LONG}"), ("d2", "u", "Sea", "document", "Tides follow the moon and the wind over the sea. " * 10), ("d3", "v", "Sun", "document", LONG), ("d4", "u", "Empty", "document", None)], "doc_id string, user_id string, title string, source_type string, text string")
    engine.ingest(docs)
    engine.ingest(docs)  # again: nothing twice
    n = engine.table("chunks").count()
    assert n == engine.table("chunks").select("chunk_id").distinct().count() == engine.vectors.count()
    hits = engine.search(engine.question("u", "panels light current"), 3).orderBy("rank").collect()
    assert hits[0]["doc_id"] == "d1" and {h["doc_id"] for h in hits} <= {"d1", "d2"}
    engine.remember("u", spark.createDataFrame([("my dog is called Rex",)], "text string"))
    assert engine.search(engine.question("u", "dog Rex"), 1, ["episodic"]).first()["text"] == "my dog is called Rex"
    assert "Rex" in engine.answer_passages(engine.question("u", "dog Rex")).first()["passages"]
    assert len(engine.forget_like("u", "my dog is called Rex")) == 1
    assert engine.search(engine.question("u", "dog Rex"), 1, ["episodic"]).count() == 0
    engine.delete(["d1"])
    assert engine.table("chunks").filter("doc_id = 'd1'").count() == 0 and engine.vectors.count(F.col("doc_id") == "d1") == 0
    assert {r["doc_id"]: r["n_chunks"] for r in engine.list_documents().collect()}["d4"] == 0


def test_turns_and_profile(spark, engine, tmp_path):
    engine.say(1, "u", "user", "what is it?")
    m = engine.say(1, "u", "assistant", "a panel")
    engine.rate(m, 1)
    engine.rate(m, -1)
    assert engine.feedback_stats().first()["down"] == 1 and engine.feedback_stats().first()["total"] == 1
    with pytest.raises(ValueError):
        engine.rate(m, 3)
    engine.export_feedback(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["question"] == "what is it?"
    engine.prefer(spark.createDataFrame([("u", "tea", "like", "green tea", 1.4), ("u", "x", "odd", "y", 0.9), ("u", "z", "fact", "z", 0.1)], "user_id string, topic string, polarity string, value string, confidence double"))
    assert engine.profile().first()["text"] == "Likes: green tea"


def test_loaders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_bytes(b"# T\n\nb\xff")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "y.docx").write_bytes(z.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.exe").write_bytes(b"x")
    got = {r["title"]: r for r in load_folder(spark, str(tmp_path)).collect()}
    assert got["x"]["text"] == "# T\n\nb�" and got["y"]["text"] == "one\ntwo" and got["bad"]["error"] and "PDF" in got["p"]["error"] and set(got) == {"x", "y", "bad", "p"}
    text, pages = load_document("q.pdf", b"", lambda _: ["first\n1", " ", "Page 2 of 9\nsecond"])
    assert text == "first\n\nsecond" and pages == [(1, 0, 5), (3, 7, 13)] and text[7:13] == "second"
    with pytest.raises(ValueError):
        load_document("a.exe", b"")


def test_vector_store(spark, tmp_path):
    v = Vectors(spark, str(tmp_path / "v"))
    assert v.dim() is None and v.count() == 0
    row = lambda i, x: (i, x, "u", "d", "document", False, 0, None)
    v.upsert(spark.createDataFrame([row("a", [1.0, 0.0]), row("b", [0.0, 1.0])], v.SCHEMA))
    v.upsert(spark.createDataFrame([row("a", [0.5, 0.5])], v.SCHEMA))
    assert v.dim() == 2 and v.count() == 2 and v.read().filter("chunk_id = 'a'").first()["embedding"] == [0.5, 0.5]
    with pytest.raises(ValueError):
        v.upsert(spark.createDataFrame([row("c", [1.0])], v.SCHEMA))
    v.update(F.col("chunk_id") == "a", excluded=F.lit(True))
    v.delete_where(F.col("excluded"))
    assert [r["chunk_id"] for r in v.read().collect()] == ["b"] and len(v.versions()) <= 3


def test_graph_folder_config_functions(spark, tmp_path):
    save_graph(spark.createDataFrame([("a", "r", "b", 1.0)], "src string, relation string, dst string, weight double"), str(tmp_path / "g"))
    nodes, edges = load_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 2 and edges.count() == 1
    (tmp_path / "c.json").write_text('{"retrieval": {"top_k": 3}}')
    c = load_config(str(tmp_path / "c.json"), env={"LODESTACK_RETRIEVAL__RRF_CONSTANT": "7", "LODESTACK_NAME": "x"})
    assert c["retrieval"]["top_k"] == 3 and c["retrieval"]["rrf_constant"] == 7 and c["name"] == "x" and c["taxonomy"]["beam"] == 3
    register(spark)
    got = spark.sql("select token_count('abcdefgh') as a, cosine_of(array(1D, 0D), array(1D, 0D)) as b, cosine_of(array(0D), array(1D)) as c, jaccard_of(array('a'), array('a', 'b')) as d").first()
    assert tuple(got) == (2, 1.0, 0.0, 0.5)


def test_model_helpers(spark):
    assert grade("I say 2 of 3") == 2 and grade("none") == 0 and json_list("```json\n[1, [2]]\n``` x") == "[1, [2]]" and json_list("no") is None
    df = spark.createDataFrame([("p",), ("p",), (None,)], "prompt string")
    empty = spark.createDataFrame([], "key string, reply string")
    assert [r["reply"] for r in complete_once(df, EchoModel("r"), empty).collect()] == ["r"] * 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(LONG)
    run = lambda *a: main(["--store", str(tmp_path / "s"), *a], spark)
    run("init")
    run("ingest", str(tmp_path / "in"))
    run("remember", "the key is under the mat")
    for c in ("list-docs", "stats", "sessions", "profile", "feedback-stats", "memory-list", "jobs"):
        run(c)
    run("search", "light current")
    assert "1 chunks" in capsys.readouterr().out
