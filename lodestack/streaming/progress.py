"""Progress of streams as a table: a listener appends events in order, at most so often; tags cancel what runs under them."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "seq long, at double, query string, kind string, batch long, rows_in long, message string"


class ProgressTable(StreamingQueryListener):
    """Events of a session's queries under path (Parquet), numbered in the order they came.

    Between two writes, `every` seconds apart at least, only the latest progress of each query is kept; starts and ends are
    always kept, and an end is written at once with what is held. `skipped` counts what was passed over.
    """

    def __init__(self, spark: SparkSession, path: str, every: float = 1.0):
        super().__init__()
        self.spark, self.path, self.every = spark, path, every
        self.lock, self.held, self.seq, self.last, self.skipped, self.writes = threading.Lock(), [], 0, 0.0, 0, []

    def onQueryStarted(self, event) -> None:
        self._add(str(event.id), "started", -1, 0, event.name or "")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(str(p.id), "progress", p.batchId, p.numInputRows, "")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(str(event.id), "failed" if event.exception else "ended", -1, 0, (event.exception or "")[:1000], now=True)

    def _add(self, query: str, kind: str, batch: int, rows: int, message: str, now: bool = False) -> None:
        with self.lock:
            if kind == "progress":
                before = len(self.held)
                self.held = [h for h in self.held if h[2] != query or h[3] != "progress"]
                self.skipped += before - len(self.held)
            self.held.append((self.seq, time.time(), query, kind, batch, rows, message))
            self.seq += 1
            if now or time.time() - self.last >= self.every:
                self._write()

    def _write(self) -> None:
        rows, self.held, self.last = self.held, [], time.time()
        if rows:
            self.writes.append(self.last)
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def flush(self) -> None:
        with self.lock:
            self._write()

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def cancel(spark: SparkSession, query: StreamingQuery, tag: str, path: str) -> None:
    """Stop a query of ingest and the jobs of its tag; the folder of a batch that was being written goes, so half a batch is never read."""
    query.stop()
    spark.interruptTag(tag)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        for s in fs.listStatus(p):
            done = spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
            if s.isDirectory() and not fs.exists(done):
                fs.delete(s.getPath(), True)
