"""One store of documents, chunks, vectors, turns and feedback, and what a user does with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import conversation as D
from .operators import mutations as M
from .operators import quality as Q
from .operators import retrieval as R
from .operators import taxonomy as X
from .operators.chunking import chunk_documents, memory_texts
from .providers import Embedder, HashEmbedder, OverlapScorer, Scorer, embed, rerank
from .sources.loaders import load_folder
from .sources.store import Table, Vectors, export_json

_TABLES = {
    "documents": ("doc_id string, user_id string, title string, source_type string, text string", ("doc_id",)),
    "chunks": ("chunk_id string, doc_id string, user_id string, title string, text string, section string, subsection string, chunk_index int, token_count int, source_type string, has_math boolean, excluded boolean", ("chunk_id",)),
    "messages": ("message_id long, session_id long, user_id string, role string, content string", ("message_id",)),
    "feedback": ("message_id string, session_id long, rating int", ("message_id",)),
    "profile": ("user_id string, topic string, polarity string, value string, confidence double", ("user_id", "topic", "polarity")),
    "nodes": ("node_id string, parent_id string, label string, depth int, is_leaf boolean", ("node_id",)),
    "assignments": ("user_id string, doc_id string, node_id string, score double, is_primary boolean", ("user_id", "doc_id", "node_id")),
    "jobs": ("job_id string, at timestamp, status string, progress int", ()),
}


class Engine:
    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, scorer: Scorer | None = None):
        self.spark, self.embedder, self.scorer = spark, embedder or HashEmbedder(), scorer or OverlapScorer()
        self.tables = {name: Table(spark, f"{folder}/{name}", schema, *keys) for name, (schema, keys) in _TABLES.items()}
        self.vectors = Vectors(spark, f"{folder}/vectors")

    def table(self, name: str) -> DataFrame:
        return self.tables[name].read()

    # documents and memories
    def ingest(self, docs: DataFrame, filtered: bool = True) -> int:
        """Store docs (doc_id, user_id, title, source_type, text); their chunks and vectors replace those they had. The number of chunks."""
        self.tables["documents"].upsert(docs)
        made = chunk_documents(docs)
        if filtered:
            made = Q.dedupe_chunks(Q.quality_reason(made).filter("reason is null or source_type = 'episodic'").drop("reason"))
        self.tables["chunks"].write(M.delete(self.table("chunks"), docs, "doc_id").unionByName(made.select(*self.table("chunks").columns)))
        mine = self.table("chunks").join(docs.select("doc_id"), "doc_id", "left_semi")
        vectors = embed(mine, self.embedder).withColumn("page", F.lit(None).cast("int"))
        old = M.delete(self.vectors.read(), docs, "doc_id")
        self.vectors.write(old.unionByName(vectors.select(*old.columns)))
        return mine.count()

    def ingest_folder(self, folder: str, user: str = "default") -> int:
        return self.ingest(load_folder(self.spark, folder, user).filter("error is null").select("doc_id", "user_id", "title", "source_type", "text"))

    def remember(self, user: str, texts: DataFrame) -> int:
        """Store memories (text), each under an id from its user and text."""
        docs = texts.select(F.concat(F.lit(f"episodic:{user}:"), F.substring(F.sha2("text", 256), 1, 16)).alias("doc_id"), F.lit(user).alias("user_id"), F.lit("memory").alias("title"), F.lit("episodic").alias("source_type"), "text")
        return self.ingest(docs.dropDuplicates(["doc_id"]), filtered=False)

    def import_memories(self, user: str, files: DataFrame) -> int:
        return self.remember(user, memory_texts(files).select("text"))

    def forget(self, user: str, doc_ids: list[str]) -> None:
        """Tombstones: the chunks stay but are found no more."""
        mine = (F.col("user_id") == user) & F.col("doc_id").isin(*doc_ids)
        self.tables["chunks"].update(mine, excluded=F.lit(True))
        self.vectors.update(mine, excluded=F.lit(True))

    def forget_like(self, user: str, text: str, least: float = 0.5) -> list[str]:
        live = Q.scope(self.vectors.read(), user, ["episodic"])
        near = R.cosine_neighbours(live, embed(self.question(user, text), self.embedder).select("query_id", "embedding"), 5, "chunk_id").filter(F.col("score") >= least)
        hits = near.join(live.select("chunk_id", "doc_id"), "chunk_id")
        found = [r[0] for r in hits.select("doc_id").distinct().collect()]  # at most five
        if found:
            self.forget(user, found)
        return found

    def delete(self, doc_ids: list[str]) -> None:
        """Documents and all that hangs on them."""
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        for t in (self.tables["documents"], self.tables["chunks"], self.tables["assignments"], self.vectors):
            t.write(M.delete(t.read(), gone, "doc_id"))

    # retrieval
    def question(self, user: str, text: str, query_id: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(query_id, user, text)], "query_id long, user_id string, text string")

    def search(self, questions: DataFrame, k: int = 10, source_types: list[str] | None = None, filter_: dict | None = None) -> DataFrame:
        """(query_id, chunk_id, doc_id, score, rank, text, title, section, source_type) by fused vector and term ranking over each asker's live chunks."""
        out = None
        for (user,) in questions.select("user_id").distinct().toLocalIterator():
            asked = questions.filter(F.col("user_id") == user)
            mine = Q.scope(self.table("chunks"), user, source_types, filter_=filter_)
            terms = R.bm25(mine.select(F.col("chunk_id").alias("doc_id"), "text"), asked.select("query_id", "text"), 2 * k)
            live = self.vectors.read().join(mine.select("chunk_id"), "chunk_id", "left_semi")
            near = R.cosine_neighbours(live, embed(asked, self.embedder).select("query_id", "embedding"), 2 * k, "chunk_id").withColumnRenamed("chunk_id", "doc_id")
            found = R.hybrid(terms, near, k).withColumnRenamed("doc_id", "chunk_id").join(mine.select("chunk_id", "doc_id", "text", "title", "section", "source_type"), "chunk_id")
            out = found if out is None else out.unionByName(found)
        return out

    def answer_passages(self, questions: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
        """(query_id, passages): searched, scored again, nudged by nobody, memories first, formatted."""
        found = self.search(questions, 2 * k).join(questions.select("query_id", F.col("text").alias("query")), "query_id")
        scored = R.threshold(rerank(found, self.scorer), least, k)
        return R.passages(R.episodic_first(scored))

    # conversation
    def say(self, session: int, user: str, role: str, content: str) -> int:
        last = self.table("messages").agg(F.max("message_id")).first()[0] or 0
        self.tables["messages"].upsert(self.spark.createDataFrame([(last + 1, session, user, role, content)], self.tables["messages"].schema))
        return last + 1

    def rate(self, message_id: int, rating: int) -> None:
        if rating not in (-1, 0, 1):
            raise ValueError("a rating is -1, 0 or 1")
        new = self.spark.createDataFrame([(str(message_id), rating)], "message_id string, rating int")
        self.tables["feedback"].write(M.rate(self.table("feedback"), new, self.table("messages")))

    def prefer(self, found: DataFrame) -> None:
        self.tables["profile"].write(M.prefer(self.table("profile"), found))

    def profile(self) -> DataFrame:
        return D.profile_text(self.table("profile"))

    # reads
    def list_documents(self) -> DataFrame:
        return C.list_documents(self.table("documents").drop("text"), self.table("chunks"))

    def stats(self) -> DataFrame:
        return C.stats_by_type(self.table("documents"), self.table("chunks"))

    def sessions(self) -> DataFrame:
        return C.sessions(self.table("messages"))

    def feedback_stats(self) -> DataFrame:
        return C.feedback_summary(self.table("feedback"))

    def export_feedback(self, path: str) -> None:
        export_json(C.rated_turns(self.table("messages"), self.table("feedback")), path)

    def jobs(self) -> DataFrame:
        return M.job_states(self.table("jobs"))

    # tree
    def build_tree(self, branches: int = 4, depth: int = 2) -> int:
        vectors = X.mean_vectors(self.vectors.read().withColumn("k", F.concat_ws("\x1f", "user_id", "doc_id")), "k", unit=True)
        part = F.split("k", "\x1f")
        nodes, filed = X.build_tree(vectors.select(part[0].alias("user_id"), part[1].alias("doc_id"), F.col("centroid").alias("embedding")), branches, depth)
        self.tables["nodes"].write(nodes)
        self.tables["assignments"].write(filed)
        return self.table("nodes").count()

    def tree(self) -> DataFrame:
        return self.table("nodes").join(X.node_counts(self.table("nodes"), self.table("assignments")), "node_id").orderBy("node_id")
