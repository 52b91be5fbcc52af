"""Files that arrive in a folder become chunks: a file source, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents
from ..operators.quality import dedupe_chunks, quality_reason
from ..sources.loaders import document_id


def text_files(spark: SparkSession, folder: str, user: str = "default", per_batch: int = 1000) -> DataFrame:
    """(doc_id, user_id, title, source_type, text) of text and Markdown files as they arrive."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(document_id(F.lit(user), F.col("path")).alias("doc_id"), F.lit(user).alias("user_id"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("title"), F.lit("document").alias("source_type"), "text")


def kept_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of docs that pass the quality chain, equal ones of a document once."""
    return dedupe_chunks(quality_reason(chunk_documents(docs)).filter("reason is null").drop("reason"))


def ingest(docs: DataFrame, to: str, checkpoint: str, tag: str = "ingest", then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Write the kept chunks of a stream of docs under to/batch=<n>.

    A batch that runs again overwrites its own folder, so each is there once. The query's tag cancels it: spark.interruptTag(tag).
    """
    def write(batch: DataFrame, n: int) -> None:
        kept_chunks(batch).write.mode("overwrite").parquet(f"{to}/batch={n}")
        if then is not None:
            then(batch.sparkSession.read.parquet(f"{to}/batch={n}"), n)

    docs.sparkSession.addTag(tag)
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
