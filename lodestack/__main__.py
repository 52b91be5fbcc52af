"""Command line: python -m lodestack --store FOLDER COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("--store", required=True)
    p.add_argument("--user", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in {"init": (), "ingest": ("path",), "search": ("text",), "remember": ("text",), "memory-list": (), "forget": ("text",), "list-docs": (), "stats": (), "sessions": (), "profile": (), "feedback-stats": (), "feedback-export": ("path",),
                        "taxonomy-build": (), "taxonomy-show": (), "delete": ("doc_id",), "jobs": ()}.items():
        c = sub.add_parser(name)
        for e in extra:
            c.add_argument(e)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    e = Engine(spark, a.store)
    match a.command:
        case "init":
            for t in e.tables.values():
                t.write(t.read())
        case "ingest":
            print(e.ingest_folder(a.path, a.user), "chunks")
        case "search":
            e.search(e.question(a.user, a.text)).select("rank", "title", F.substring("text", 1, 80).alias("text")).orderBy("rank").show(20, False)
        case "remember":
            print(e.remember(a.user, spark.createDataFrame([(a.text,)], "text string")), "chunks")
        case "memory-list":
            e.table("documents").filter((F.col("source_type") == "episodic") & (F.col("user_id") == a.user)).select("doc_id", "text").show(50, False)
        case "forget":
            print(e.forget_like(a.user, a.text))
        case "delete":
            e.delete([a.doc_id])
        case "feedback-export":
            e.export_feedback(a.path)
        case "taxonomy-build":
            print(e.build_tree(), "nodes")
        case other:
            {"list-docs": e.list_documents, "stats": e.stats, "sessions": e.sessions, "profile": e.profile, "feedback-stats": e.feedback_stats, "taxonomy-show": e.tree, "jobs": e.jobs}[other]().show(200, False)


if __name__ == "__main__":
    main()
