import json
import threading
import urllib.request

from lodestack.api import Api, serve
from lodestack.engine import Engine

LONG = "Solar panels turn light into current. " * 12


def test_routes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    go = Api(e).handle
    assert go("POST", "/documents", {"documents": [{"doc_id": "d1", "user_id": "u", "title": "Sun", "source_type": "document", "text": LONG}]}) == (200, 1)
    assert go("GET", "/documents/d1")[1]["n_chunks"] == 1 and go("GET", "/documents/d9")[0] == 404 and go("GET", "/documents/d1/preview")[1]["text"] == LONG.strip()
    assert go("POST", "/search", {"user": "u", "text": "light current", "k": 1})[1][0]["doc_id"] == "d1" and go("POST", "/search", {})[0] == 400
    assert go("POST", "/memories/u", {"texts": ["my dog is Rex"]}) == (200, 1)
    old = go("GET", "/memories/u")[1][0]["doc_id"]
    assert go("PUT", f"/memories/u/{old}", {"text": "my dog is Max"})[0] == 200
    now = go("GET", "/memories/u")[1]
    assert [m["text"] for m in now] == ["my dog is Max"] and now[0]["doc_id"] != old and e.vectors.read().filter(f"doc_id = '{old}'").count() == 0
    go("POST", "/sessions/1", {"user": "u", "role": "user", "content": "who?"})
    answer = go("POST", "/sessions/1", {"user": "u", "role": "assistant", "content": "me"})[1]
    assert go("PUT", f"/feedback/{answer}", {"rating": 5})[0] == 400 and go("PUT", f"/feedback/{answer}", {"rating": -1})[0] == 200
    assert go("GET", "/feedback/negative")[1][0]["question"] == "who?" and go("GET", "/sessions?limit=1")[1][0]["title"] == "who?"
    go("DELETE", f"/feedback/{answer}")
    assert go("GET", "/feedback/summary")[1]["total"] == 0
    go("PUT", "/profile/u", {"preferences": [{"topic": "tea", "polarity": "like", "value": "green"}]})
    go("DELETE", "/profile/u/tea/like")
    assert go("GET", "/profile/u")[1] == []
    go("POST", "/jobs/j", {"status": "running", "progress": 3})
    go("DELETE", "/jobs/j")
    assert go("GET", "/jobs")[1][0]["status"] == "cancelled" and go("POST", "/jobs/j", {"status": "odd"})[0] == 400
    assert go("DELETE", "/documents/d1")[0] == 200 and go("GET", "/documents/d1")[0] == 404 and go("GET", "/nowhere")[0] == 404


def test_tree_routes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    go = Api(e).handle
    e.tables["nodes"].write(spark.createDataFrame([("root", None, "all", 0, False), ("a", "root", "a", 1, True), ("b", "root", "b", 1, True)], e.tables["nodes"].schema))
    assert go("PUT", "/tree/a/documents/d1", {"user": "u"})[0] == 200 and go("PUT", "/tree/root/documents/d1", {"user": "u"})[0] == 400
    assert go("GET", "/tree/root/documents")[1] == [{"doc_id": "d1"}]
    assert go("PUT", "/tree/a/parent", {"parent": "b"})[0] == 200 and go("PUT", "/tree/b/parent", {"parent": "a"})[0] == 400
    tree = go("GET", "/tree")[1]["roots"][0]
    assert tree["n"] == 1 and tree["children"][0]["id"] == "b" and tree["children"][0]["children"][0]["n"] == 1
    assert go("DELETE", "/tree/a", {"to": "b"})[0] == 200 and go("GET", "/tree/b/documents")[1] == [{"doc_id": "d1"}]


def test_server(spark, tmp_path):
    s = serve(Engine(spark, str(tmp_path / "s")), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/documents") as r:
        assert json.loads(r.read()) == []
    s.shutdown()
