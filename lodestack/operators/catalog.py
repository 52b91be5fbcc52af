"""Catalogue, session, feedback and job reads, and the exact percentile that reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# tables: documents (doc_id, user_id, title, source_type, text), chunks (chunk_id, doc_id, chunk_index, text, excluded), messages (message_id,
# session_id, role, content), feedback (message_id, session_id, rating, created_at)


def list_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with the number of its live chunks, 0 included."""
    live = chunks.filter(~F.col("excluded")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return docs.join(live, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))


def filed_documents(docs: DataFrame, assignments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with each of their tree nodes (null: unfiled) and their chunk count; a document filed twice is there twice."""
    counted = list_documents(docs, chunks)
    return counted.join(assignments.select("doc_id", "node_id", "is_primary"), "doc_id", "left")


def unfiled(docs: DataFrame, assignments: DataFrame) -> DataFrame:
    return docs.join(assignments.select("user_id", "doc_id"), ["user_id", "doc_id"], "left_anti")


def live_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have a live chunk."""
    return docs.join(chunks.filter(~F.col("excluded")).select("doc_id"), "doc_id", "left_semi")


def summaries(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, label): the summary, else the title."""
    return docs.join(meta.select("doc_id", "summary"), "doc_id", "left").select("doc_id", F.coalesce("summary", "title").alias("label"))


def stats_by_type(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_type, n_documents, n_chunks, n_live), with a row for the total (null type)."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.col("excluded")).alias("live"))
    rows = docs.join(per, "doc_id", "left")
    return rows.rollup("source_type").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("live"), F.lit(0)).alias("n_live"))


def top_documents(docs: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    return list_documents(docs, chunks).orderBy(F.desc("n_chunks"), "doc_id").limit(k).select("doc_id", "n_chunks")


def concat_text(chunks: DataFrame, separator: str = "\n\n", first: int | None = None, longest: int | None = None) -> DataFrame:
    """(doc_id, text): live chunks of each document in order, all or the first few, cut to `longest` characters."""
    rows = chunks.filter(~F.col("excluded"))
    if first is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))).filter(F.col("__n") <= first)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), separator)
    return rows.groupBy("doc_id").agg((text if longest is None else F.substring(text, 1, longest)).alias("text"))


def sessions(messages: DataFrame, longest: int = 60, latest: int = 200) -> DataFrame:
    """(session_id, n_messages, title): the latest sessions by their last message; a title is the first user message, shortened."""
    first = F.min(F.when(F.col("role") == "user", F.struct("message_id", "content")))["content"]
    s = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), first.alias("said"), F.max("message_id").alias("last"))
    title = F.when(F.length("said") > longest, F.concat(F.substring("said", 1, longest), F.lit("…"))).otherwise(F.coalesce("said", F.lit("")))
    return s.withColumn("title", title).orderBy(F.desc("last"), "session_id").limit(latest).select("session_id", "n_messages", "title")


def preceding_question(messages: DataFrame) -> DataFrame:
    """messages with question: the last user message before each, in its session (as-of)."""
    w = Window.partitionBy("session_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("content")), True).over(w))


def rated_turns(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """(message_id, session_id, rating, question, answer): rated messages, the feedback's id read as a number."""
    asked = preceding_question(messages)
    f = feedback.filter("rating <> 0").select(F.col("message_id").cast("long").alias("message_id"), "rating")
    return asked.join(f, "message_id").select("message_id", "session_id", "rating", "question", F.col("content").alias("answer"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count_if(F.col("rating") == 1).alias("up"), F.count_if(F.col("rating") == -1).alias("down"), F.count_if(F.col("rating") != 0).alias("total"),
                        F.count_distinct(F.when(F.col("rating") != 0, F.col("session_id"))).alias("n_sessions"))


def latest_negative(messages: DataFrame, feedback: DataFrame, k: int = 5) -> DataFrame:
    """The latest answers rated down, with their question."""
    return rated_turns(messages, feedback).filter("rating = -1").orderBy(F.desc("message_id")).limit(k)


def session_tokens(messages: DataFrame, budget: int = 4000) -> DataFrame:
    """(session_id, tokens, over): tokens of each session against the budget."""
    from ..functions.text import token_count

    return messages.groupBy("session_id").agg(F.sum(token_count(F.col("content"))).alias("tokens")).withColumn("over", F.col("tokens") > budget)


def feedback_ema(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Closed form of the moving average of +1/-1 signals per user, the first of which seeds it."""
    s = events.withColumn("s", F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "error", -1.0)).filter("s is not null")
    by = Window.partitionBy("user_id")
    s = s.withColumn("i", F.row_number().over(by.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(by))
    w = F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(alpha)
    return s.groupBy("user_id").agg(F.round(F.sum(F.col("s") * w), 6).alias("ema"), F.count("*").alias("n_signals"))


def _by_key(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows with small's row of the same k, null being a key too."""
    return rows.join(small.withColumnRenamed("k", "__k"), F.col("k").eqNullSafe(F.col("__k"))).drop("__k")


def exact_percentiles(df: DataFrame, key: str, value: str, probs: dict[str, float], limit: int = 1 << 20, accuracy: int = 10_000) -> DataFrame:
    """(key, one column a name of probs, n): interpolated percentiles of value, exact, for few keys.

    Approximate percentiles bracket each rank; brackets narrow until one holds at most `limit` rows, and only its distinct
    values with their counts are gathered. Null values do not count; a null key is a key.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    out = rows.groupBy("k").agg(F.count("*").alias("n"))
    for name, p in probs.items():
        state = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("n"))
        held = state.collect()  # one row a key
        while True:
            state = F.broadcast(rows.sparkSession.createDataFrame(held, "k string, n long, lo double, hi double, below long, inside long")) if held else None
            if state is None or max(r["inside"] for r in held) <= limit or all(r["lo"] == r["hi"] for r in held):
                break
            near = _by_key(rows.withColumn("k", F.col("k").cast("string")), state).filter("v between lo and hi")
            cuts = near.groupBy("k", "n", "lo", "hi", "below", "inside").agg(F.percentile_approx("v", [i / 256 for i in range(257)], accuracy).alias("q")).collect()
            fresh = []
            for r in cuts:
                at = min(1.0, max(0.0, ((r["n"] - 1) * p - r["below"]) / max(1, r["inside"] - 1)))
                lo, hi = r["q"][max(0, int(at * 256) - 2)], r["q"][min(256, int(at * 256) + 3)]
                fresh.append((r["k"], r["n"], lo, hi))
            edges = F.broadcast(rows.sparkSession.createDataFrame(fresh, "k string, n long, lo double, hi double"))
            counted = _by_key(rows.withColumn("k", F.col("k").cast("string")), edges).groupBy("k", "n", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"))
            now = counted.collect()
            if sum(r["inside"] for r in now) >= sum(r["inside"] for r in held):
                held = now
                break
            held = now
        if not held:
            return out.select(F.col("k").alias(key), *[F.lit(None).cast("double").alias(c) for c in probs], "n")
        near = _by_key(rows.withColumn("k", F.col("k").cast("string")), state).filter("v between lo and hi").groupBy("k", "n", "below", "v").agg(F.count("*").alias("c"))
        last = F.sum("c").over(Window.partitionBy("k").orderBy("v")) + F.col("below")
        rank = (F.col("n") - 1) * F.lit(p)
        ends = near.withColumn("last", last).groupBy("k", "n").agg(F.min(F.when(F.col("last") > F.floor(rank), F.col("v"))).alias("a"), F.min(F.when(F.col("last") > F.ceil(rank), F.col("v"))).alias("b"))
        part = rank - F.floor(rank)
        ends = ends.select("k", F.round(F.col("a") + (F.coalesce("b", "a") - F.col("a")) * part, 6).alias(name))
        out = out.join(F.broadcast(ends.withColumnRenamed("k", "__k")), F.col("k").cast("string").eqNullSafe(F.col("__k"))).drop("__k")
    return out.select(F.col("k").alias(key), *probs, "n")


def latency(events: DataFrame) -> DataFrame:
    return exact_percentiles(events, "event_type", "value", {"median": 0.5, "p95": 0.95})


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Upsert semantics: the last row of each key, by a mergeable maximum."""
    at = F.struct(*order)
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), at).alias("r")).select(key, "r.*")


def recent_messages(conversations: DataFrame, limit: int = 6) -> DataFrame:
    """The last `limit` turns of each conversation before the current one: a last turn by the user is the current one.

    Turns of equal number are ordered by role and text.
    """
    order = [F.desc("turn"), F.desc("role"), F.desc("text")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    last = F.first("role").over(w)
    ranked = conversations.withColumn("__i", F.row_number().over(w)).withColumn("__now", F.coalesce((last == "user"), F.lit(False)).cast("int"))
    return ranked.withColumn("back", F.col("__i") - F.col("__now")).filter((F.col("back") >= 1) & (F.col("back") <= limit)).drop("__i", "__now")


def jobs(log: DataFrame, latest: int = 50) -> DataFrame:
    """The latest jobs with their last state, from a log (job_id, at, status, progress)."""
    return latest_per_key(log, "job_id", "at", "progress").orderBy(F.desc("at"), "job_id").limit(latest)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)
