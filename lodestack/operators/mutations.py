"""Upserts, deletes and guards as functions from tables to tables; a caller writes the result over a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """table with rows in place of those of equal keys; of several new rows of one key the greatest stays. Null keys are equal."""
    new = rows.select(*table.columns)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in new.columns if c not in keys] or [F.lit(0)]))
    new = new.withColumn("__n", at).filter("__n = 1").drop("__n")
    marks = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = c if same is None else same & c
    return table.join(marks, same, "left_anti").unionByName(new)


def delete(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_documents(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents (doc_id) that go."""
    return {name: delete(t, gone, "doc_id") for name, t in tables.items()}


def delete_sessions(gone: DataFrame, messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete(messages, gone, "session_id"), delete(sessions, gone, "session_id")


def tombstone(chunks: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks with excluded set for the keys that go."""
    marks = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    return chunks.join(marks, key, "left").withColumn("excluded", F.col("excluded") | F.coalesce("__gone", F.lit(False))).drop("__gone").select(*chunks.columns)


def edit_memory(docs: DataFrame, chunks: DataFrame, assignments: DataFrame, old: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A memory under a new id, derived from its text; its filings follow, its old rows go."""
    new = F.concat(F.lit("episodic:"), F.substring(F.sha2(F.concat(F.lit(old), F.lit("\x1f"), F.lit(text)), 256), 1, 16))
    d = docs.withColumn("__m", F.col("doc_id") == old).withColumn("text", F.when(F.col("__m"), F.lit(text)).otherwise(F.col("text"))).withColumn("doc_id", F.when(F.col("__m"), new).otherwise(F.col("doc_id"))).drop("__m")
    first = chunks.filter((F.col("doc_id") == old) & (F.col("chunk_index") == 0)).withColumn("doc_id", new).withColumn("text", F.lit(text))
    c = chunks.filter(F.col("doc_id") != old).unionByName(first)
    a = assignments.withColumn("doc_id", F.when(F.col("doc_id") == old, new).otherwise(F.col("doc_id")))
    return d, c, a


def rate(feedback: DataFrame, ratings: DataFrame, messages: DataFrame) -> DataFrame:
    """feedback with new ratings (message_id, rating, created_at), one a message; the session is the message's. Ratings are -1, 0 or 1."""
    known = ratings.filter(F.col("rating").isin(-1, 0, 1)).join(messages.select(F.col("message_id").cast("string").alias("message_id"), "session_id"), "message_id")
    return upsert(feedback, known.select(*feedback.columns), "message_id")


def prefer(profile: DataFrame, found: DataFrame, least: float = 0.7) -> DataFrame:
    """profile (user_id, topic, polarity, value, confidence) with the found preferences of valid polarity and enough confidence."""
    good = found.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).filter((F.col("confidence") >= least) & F.col("polarity").isin("like", "dislike", "fact", "style"))
    return upsert(profile, good, "user_id", "topic", "polarity")


# The states of a job and those that end it.
STATES, ENDED = ("queued", "running", "done", "failed", "cancelled"), ("done", "failed", "cancelled")


def job_states(log: DataFrame) -> DataFrame:
    """(job_id, status, progress, at): the state of each job after its log; the first state that ends it stands."""
    rows = log.filter(F.col("status").isin(*STATES))
    ended = F.min(F.when(F.col("status").isin(*ENDED), F.struct("at", "status", "progress")))
    last = F.max(F.struct("at", "status", "progress"))
    return rows.groupBy("job_id").agg(F.coalesce(ended, last).alias("s")).select("job_id", "s.status", "s.progress", "s.at")


def backfill_math(chunks: DataFrame) -> DataFrame:
    """chunks with has_math recomputed, and changed where it differed."""
    from ..functions.text import has_math

    return chunks.withColumn("__new", has_math(F.col("text"))).withColumn("changed", ~F.col("__new").eqNullSafe(F.col("has_math"))).withColumn("has_math", F.col("__new")).drop("__new")


def check_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> None:
    """ValueError if a stored vector has another dimension."""
    bad = vectors.filter(F.size(column) != dim).select(F.size(column)).limit(1).collect()
    if bad:
        raise ValueError(f"stored vectors have {bad[0][0]} dimensions, not {dim}")
