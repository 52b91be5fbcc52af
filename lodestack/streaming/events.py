"""Feedback averages as a stream's state, sessions that close, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def feedback_ema(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(user_id, ema, n_signals) after each micro-batch that has signals of a user; the first signal seeds, neutral ones do not count.

    Within a batch signals are taken by time and id; the batches' order is the stream's.
    """
    signals = events.withColumn("s", F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "error", -1.0)).filter("s is not null").select("user_id", "ts", "event_id", "s")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for s in rows["s"]:
            ema, n = (float(s) if n == 0 else alpha * float(s) + (1 - alpha) * ema), n + 1
        state.update((ema, n))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [round(ema, 6)], "n_signals": [n]})

    return signals.groupBy("user_id").applyInPandasWithState(step, "user_id long, ema double, n_signals long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, end, event_type, n, total) of tumbling or sliding windows; events later than the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): a user's events without a pause of `gap`, sent once the session is closed."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
