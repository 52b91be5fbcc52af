"""Category trees out of a model's reply: reading of fenced and cut JSON, and nodes and filings with what is invented left out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import taxonomy as X

NODES = "node_id string, parent_id string, label string, description string, depth int, is_leaf boolean, keywords array<string>, doc_ids array<string>"


def _read(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def repaired(reply: str | None) -> dict | None:
    """The first JSON object of a reply; of one that is cut off, all members and items that are whole.

    Fences and prose around it do not matter. One pass keeps the brackets that are open and the last place where everything
    before is whole (behind an opening or closing bracket, or in front of a comma); a cut reply is closed at its end if that reads, else there.
    """
    text = reply or ""
    start = text.find("{")
    if start < 0:
        return None
    text, open_, safe, quoted, skip = text[start:], [], (0, ""), False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
            safe = i + 1, "".join(reversed(open_))
        elif c == ",":
            safe = i, "".join(reversed(open_))
        elif c in "}]":
            if not open_ or open_.pop() != c:
                break
            safe = i + 1, "".join(reversed(open_))
            if not open_:
                found = _read(text[:i + 1])
                return found if isinstance(found, dict) else None
    whole = None if quoted else _read(text + "".join(reversed(open_)))
    found = whole if whole is not None else _read(text[:safe[0]] + safe[1])
    return found if isinstance(found, dict) else None


def tree_of(reply: str | None, max_depth: int = 4) -> list[tuple]:
    """NODES rows of a reply's tree, the root first, children in their order; a node's id is its path of places.

    A node with neither documents nor children is left out; what has nodes below it is no leaf, what has none is one. At max_depth a node becomes a leaf
    with all documents below it. Labels default to Unnamed; what is not of its kind (children that are no objects, ids that are no texts) is passed over.
    """
    found = repaired(reply)
    tree = found.get("tree") if found else None
    out = [("root", None, "root", "", 0, True, [], [])]
    if not isinstance(tree, dict):
        return out

    def texts(x: Any) -> list[str]:
        return [t for t in x if isinstance(t, str)] if isinstance(x, list) else []

    def nodes(x: Any) -> list[dict]:
        return [n for n in x if isinstance(n, dict)] if isinstance(x, list) else []

    def below(n: dict) -> list[str]:
        return texts(n.get("doc_ids")) + [d for c in nodes(n.get("children")) for d in below(c)]

    todo = [(c, "root", f"root.{i}", 1) for i, c in reversed(list(enumerate(nodes(tree.get("children")))))]
    while todo:
        n, parent, name, depth = todo.pop()
        children, docs = nodes(n.get("children")), texts(n.get("doc_ids"))
        if not children and not docs:
            continue
        if depth >= max_depth:
            children, docs = [], below(n)
        label, about = (str(n.get(k) or "").strip() for k in ("label", "description"))
        words = [w.strip() for w in texts(n.get("keywords")) if w.strip()]
        out.append((name, parent, label or "Unnamed", about, depth, not children, words, [] if children else docs))
        todo += [(c, name, f"{name}.{i}", depth + 1) for i, c in reversed(list(enumerate(children)))]
    parents = {n[1] for n in out}
    return [(*n[:5], n[0] not in parents, *n[6:]) for n in out]


def tree_from_reply(replies: DataFrame, docs: DataFrame, max_depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, filings) by tree: of each (tree_id, reply), nodes (tree_id, NODES without doc_ids) and filings (tree_id, doc_id, node_id, score, is_primary).

    Filings name only documents of docs (doc_id); one that a reply files at several leaves is primary at the first. A reply is what a model can say at once;
    replies are read where they lie.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in NODES.split(", ")]
        for pdf in batches:
            for tree, reply in zip(pdf["tree_id"], pdf["reply"]):
                yield pd.DataFrame(tree_of(reply, max_depth), columns=columns).assign(tree_id=tree)

    kind = replies.schema["tree_id"].dataType.simpleString()
    rows = written(replies.select("tree_id", "reply").mapInPandas(read, f"{NODES}, tree_id {kind}"))
    said = rows.select("tree_id", "node_id", F.posexplode("doc_ids").alias("place", "__d"))
    real = said.join(docs.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("__d")).distinct(), "__d")
    once = real.groupBy("tree_id", "doc_id", "node_id").agg(F.min("place").alias("place"))
    # ids are paths of places: padded, they sort in the reply's order
    order = F.transform(F.split("node_id", r"\."), lambda x: F.lpad(x, 9, "0"))
    first = F.row_number().over(Window.partitionBy("tree_id", "doc_id").orderBy(order, "place"))
    filings = once.withColumn("is_primary", first == 1).select("tree_id", "doc_id", "node_id", F.lit(1.0).alias("score"), "is_primary")
    return rows.drop("doc_ids"), filings


def file_overflow(nodes: DataFrame, filings: DataFrame, vectors: DataFrame) -> DataFrame:
    """filings of one tree with every other row of vectors (doc_id, embedding) filed by descent through the centroids of what is filed."""
    filed = filings.filter("is_primary").select("doc_id", "node_id").join(vectors, "doc_id")
    tree = X.tree_centroids(nodes.select("node_id", "parent_id", "label", "depth", "is_leaf"), X.mean_vectors(filed, "node_id"))
    rest = vectors.join(filings.select("doc_id").distinct(), "doc_id", "left_anti").filter("embedding is not null")
    more = X.assign(rest, tree).select("doc_id", "node_id", "score", "is_primary")
    return filings.select("doc_id", "node_id", "score", "is_primary").unionByName(more)
