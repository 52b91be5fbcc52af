"""The engine over HTTP: one function from a request to a status and a JSON value, and a small server around it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .operators import catalog as C
from .operators import mutations as M
from .operators import taxonomy as X

PAGE = 200
Handler = Callable[..., Any]


class Api:
    """Lists are pages: `limit` rows (at most PAGE) from `offset` in a stated order."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.routes: list[tuple[str, re.Pattern[str], Handler]] = []
        e, t = engine, engine.table

        def route(method: str, path: str, handler: Handler) -> None:
            self.routes.append((method, re.compile(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + r"/?\Z"), handler))

        def gone(name: str, **keys: str) -> None:
            """Delete the rows of a table whose keys are these."""
            condition = None
            for c, v in keys.items():
                x = F.col(c).cast("string") == v
                condition = x if condition is None else condition & x
            e.tables[name].delete_where(condition)

        route("GET", "/documents", lambda q, b: self.page(e.list_documents(), q, "doc_id"))
        route("POST", "/documents", lambda q, b: e.ingest(self.rows(b["documents"], "doc_id string, user_id string, title string, source_type string, text string")))
        route("POST", "/documents/folder", lambda q, b: e.ingest_folder(b["folder"], b.get("user", "default")))
        route("GET", "/documents/{doc}", lambda q, b, doc: self.one(e.list_documents().filter(F.col("doc_id") == doc)))
        route("GET", "/documents/{doc}/preview", lambda q, b, doc: self.one(C.concat_text(t("chunks").filter(F.col("doc_id") == doc), first=3, longest=800)))
        route("GET", "/documents/{doc}/chunks", lambda q, b, doc: self.page(t("chunks").filter(F.col("doc_id") == doc), q, "chunk_index"))
        route("DELETE", "/documents/{doc}", lambda q, b, doc: e.delete([doc]))
        route("GET", "/stats", lambda q, b: self.page(e.stats(), q, "source_type"))
        route("POST", "/search", lambda q, b: self.page(e.search(e.question(b["user"], b["text"]), int(b.get("k", 10)), b.get("source_types"), b.get("where")), q, "rank"))
        route("POST", "/passages", lambda q, b: self.one(e.answer_passages(e.question(b["user"], b["text"]), int(b.get("k", 5)))))
        route("GET", "/sessions", lambda q, b: self.page(e.sessions(), q, "session_id"))
        route("GET", "/sessions/{session}", lambda q, b, session: self.page(t("messages").filter(F.col("session_id").cast("string") == session), q, "message_id"))
        route("POST", "/sessions/{session}", lambda q, b, session: e.say(int(session), b["user"], b["role"], b["content"]))
        route("DELETE", "/sessions/{session}", lambda q, b, session: gone("messages", session_id=session))
        route("GET", "/memories/{user}", lambda q, b, user: self.page(C.live_documents(t("documents").filter((F.col("source_type") == "episodic") & (F.col("user_id") == user)), t("chunks")), q, "doc_id"))
        route("POST", "/memories/{user}", lambda q, b, user: e.remember(user, self.rows([{"text": x} for x in b["texts"]], "text string")))
        route("PUT", "/memories/{user}/{doc}", self.edit)
        route("DELETE", "/memories/{user}/{doc}", lambda q, b, user, doc: e.delete([doc]))
        route("POST", "/memories/{user}/forget", lambda q, b, user: e.forget_like(user, b["text"], float(b.get("least", 0.5))))
        route("GET", "/feedback", lambda q, b: self.page(C.rated_turns(t("messages"), t("feedback")), q, "message_id"))
        route("GET", "/feedback/summary", lambda q, b: self.one(e.feedback_stats()))
        route("GET", "/feedback/negative", lambda q, b: self.page(C.latest_negative(t("messages"), t("feedback")), q, "message_id"))
        route("PUT", "/feedback/{message}", lambda q, b, message: e.rate(int(message), int(b["rating"])))
        route("DELETE", "/feedback/{message}", lambda q, b, message: gone("feedback", message_id=message))
        route("GET", "/profile/{user}", lambda q, b, user: self.page(t("profile").filter(F.col("user_id") == user), q, "topic"))
        route("PUT", "/profile/{user}", lambda q, b, user: e.prefer(self.rows([{"user_id": user, "confidence": 1.0, **x} for x in b["preferences"]], "user_id string, topic string, polarity string, value string, confidence double")))
        route("DELETE", "/profile/{user}/{topic}/{polarity}", lambda q, b, user, topic, polarity: gone("profile", user_id=user, topic=topic, polarity=polarity))
        route("GET", "/jobs", lambda q, b: self.page(e.jobs().withColumn("at", F.col("at").cast("string")), q, "job_id"))
        route("POST", "/jobs/{job}", lambda q, b, job: self.log(job, b["status"], int(b.get("progress", 0))))
        route("DELETE", "/jobs/{job}", lambda q, b, job: self.log(job, "cancelled", 0))
        route("GET", "/tree", lambda q, b: self.nested())
        route("POST", "/tree", lambda q, b: e.build_tree(int(b.get("branches", 4)), int(b.get("depth", 2))))
        route("DELETE", "/tree", lambda q, b: [x.write(x.read().limit(0)) for x in (e.tables["nodes"], e.tables["assignments"])] and None)
        route("GET", "/tree/unfiled", lambda q, b: self.page(C.unfiled(t("documents").drop("text"), t("assignments")), q, "doc_id"))
        route("GET", "/tree/{node}/documents", lambda q, b, node: self.page(X.documents_below(t("nodes"), t("assignments"), node), q, "doc_id"))
        route("PUT", "/tree/{node}/parent", lambda q, b, node: e.tables["nodes"].write(X.move(t("nodes"), node, b["parent"])))
        route("PUT", "/tree/{node}/label", lambda q, b, node: e.tables["nodes"].update(F.col("node_id") == node, label=F.lit(b["label"])))
        route("PUT", "/tree/{node}/documents/{doc}", lambda q, b, node, doc: self.file(node, doc, b["user"]))
        route("DELETE", "/tree/{node}/documents/{doc}", lambda q, b, node, doc: gone("assignments", node_id=node, doc_id=doc))
        route("DELETE", "/tree/{node}", self.prune)

    def rows(self, given: list[dict], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return self.engine.spark.createDataFrame([tuple(x.get(n) for n in names) for x in given], schema)

    def page(self, df: DataFrame, q: dict[str, str], order: str) -> list[dict]:
        limit, offset = min(PAGE, int(q.get("limit", PAGE))), int(q.get("offset", 0))
        return [r.asDict(True) for r in df.orderBy(order).offset(offset).limit(limit).collect()]

    def one(self, df: DataFrame) -> dict:
        row = df.first()
        if row is None:
            raise KeyError("nothing of that name")
        return row.asDict(True)

    def edit(self, q: dict, b: dict, user: str, doc: str) -> None:
        e = self.engine
        docs, chunks, filed = M.edit_memory(e.table("documents"), e.table("chunks"), e.table("assignments"), doc, b["text"])
        new = e.spark.range(1).select(F.concat(F.lit("episodic:"), F.substring(F.sha2(F.concat(F.lit(doc), F.lit("\x1f"), F.lit(b["text"])), 256), 1, 16))).first()[0]
        e.tables["assignments"].write(filed)
        e.tables["documents"].write(docs)
        e.tables["chunks"].write(chunks.filter(F.col("doc_id") != new))
        e.vectors.delete_where(F.col("doc_id") == doc)
        e.ingest(e.table("documents").filter(F.col("doc_id") == new), filtered=False)

    def log(self, job: str, status: str, progress: int) -> None:
        if status not in M.STATES:
            raise ValueError(f"a job is one of {', '.join(M.STATES)}")
        table = self.engine.tables["jobs"]
        new = self.engine.spark.range(1).select(F.lit(job).alias("job_id"), F.current_timestamp().alias("at"), F.lit(status).alias("status"), F.lit(progress).alias("progress"))
        table.write(table.read().unionByName(new))

    def file(self, node: str, doc: str, user: str) -> None:
        leaf = self.engine.table("nodes").filter(F.col("node_id") == node).first()
        if leaf is None or not leaf["is_leaf"]:
            raise ValueError("documents are filed under leaves")
        self.engine.tables["assignments"].upsert(self.rows([{"user_id": user, "doc_id": doc, "node_id": node, "score": 1.0, "is_primary": True}], "user_id string, doc_id string, node_id string, score double, is_primary boolean"))

    def prune(self, q: dict, b: dict, node: str) -> None:
        nodes, filed = X.remove(self.engine.table("nodes"), self.engine.table("assignments"), node, b.get("to"))
        self.engine.tables["assignments"].write(filed)
        self.engine.tables["nodes"].write(nodes)

    def nested(self) -> dict:
        """The tree as nested objects; it is a handful of nodes a level."""
        rows = [r.asDict() for r in self.engine.tree().collect()]
        below: dict = {}
        for r in rows:
            below.setdefault(r["parent_id"], []).append(r)
        grow = lambda r: {"id": r["node_id"], "label": r["label"], "n": r["n"], "children": [grow(c) for c in below.get(r["node_id"], [])]}
        return {"roots": [grow(r) for r in below.get(None, [])]}

    def handle(self, method: str, target: str, body: dict | None = None) -> tuple[int, Any]:
        """(status, value): 404 for what is not there, 400 for what cannot be done."""
        at = urlsplit(target)
        for verb, path, handler in self.routes:
            m = path.match(at.path)
            if verb == method and m:
                try:
                    return 200, handler({k: v[-1] for k, v in parse_qs(at.query).items()}, body or {}, **{k: unquote(v) for k, v in m.groupdict().items()})
                except KeyError as e:
                    return (404 if "nothing" in str(e) else 400), {"error": str(e.args[0])}
                except (ValueError, TypeError) as e:
                    return 400, {"error": str(e)}
        return 404, {"error": "no such route"}


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> HTTPServer:
    """A server for one user's machine; call serve_forever on it."""
    api = Api(engine)

    class Request(BaseHTTPRequestHandler):
        def answer(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, value = api.handle(self.command, self.path, json.loads(raw) if raw else {})
            except ValueError as e:
                status, value = 400, {"error": str(e)}
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

    return HTTPServer((host, port), Request)
