"""Conversations as a stream's state: names, running clusters and a timer for each session, which reports when it closes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversation import entities
from ..providers import hash_embedding

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "session_id long, closed_at timestamp, n_messages long, names array<string>, clusters array<array<long>>"


class SessionState(StatefulProcessor):
    """Per session: a map of names to their last place, a list of the latest messages, a map of clusters, a count; and one event-time timer.

    The same rules as conversation.tracked_entities and conversation.compact: names beyond `most` leave from the oldest on; a message is clustered
    once `keep` newer ones are there. A pause of `gap_ms` after the last message closes the session: its row is sent and its
    state deleted.
    """

    def __init__(self, gap_ms: int, most: int, keep: int, longer: int, alike: float, dim: int):
        self.gap_ms, self.most, self.keep, self.longer, self.alike, self.dim = gap_ms, most, keep, longer, alike, dim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "name string", "message_id long, place int")
        self.latest = handle.getListState("latest", "message_id long, content string")
        self.clusters = handle.getMapState("clusters", "no int", "mean array<double>, members array<long>")
        self.seen = handle.getValueState("seen", "n long, last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("message_id")
        n, last = self.seen.get() if self.seen.exists() else (0, None)
        latest = [tuple(x) for x in self.latest.get()] if self.latest.exists() else []
        names = {k[0]: tuple(v) for k, v in self.names.iterator()}
        old = set(names)
        for message, content, found in zip(batch["message_id"], batch["content"], batch["names"]):
            for place, name in enumerate(found):
                names[name] = max(names.get(name, (-1, -1)), (int(message), place))
            latest.append((int(message), content or ""))
        kept = dict(sorted(names.items(), key=lambda x: x[1])[-self.most:])
        for name in old - set(kept):
            self.names.removeKey((name,))
        for name, at in kept.items():
            self.names.updateValue((name,), at)
        for message, content in latest[:-self.keep]:
            self._cluster(message, content)
        self.latest.put(latest[-self.keep:])
        now = int(batch["ts"].max().timestamp() * 1000)
        if last is not None:
            self.handle.deleteTimer(last + self.gap_ms)
        last = max(now, last or 0)
        self.handle.registerTimer(last + self.gap_ms)
        self.seen.update((n + len(batch), last))
        return iter(())

    def _cluster(self, message: int, content: str) -> None:
        v = hash_embedding(content, self.dim)
        held = sorted((k[0], np.array(m), list(ids)) for k, (m, ids) in self.clusters.iterator())
        s = [float(v @ m) for _, m, _ in held]
        j = int(np.argmax(s)) if s else -1
        if j >= 0 and s[j] > self.alike:
            no, m, ids = held[j]
            mean = (m * len(ids) + v) / (len(ids) + 1)
            self.clusters.updateValue((no,), ((mean / (np.linalg.norm(mean) or 1)).tolist(), [*ids, message]))
        else:
            self.clusters.updateValue((len(held),), (v.tolist(), [message]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, _ = self.seen.get()
        names = sorted(((tuple(at), k[0]) for k, at in self.names.iterator()), reverse=True)
        groups = [list(ids) for _, ids in sorted((k[0], v[1]) for k, v in self.clusters.iterator())] if n > self.longer else []
        for state in (self.names, self.latest, self.clusters, self.seen):
            state.clear()
        yield pd.DataFrame({"session_id": [key[0]], "closed_at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")], "n_messages": [n], "names": [[x for _, x in names]], "clusters": [groups]})

    def close(self) -> None:
        pass


def closing_sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", most: int = 50, keep: int = 6, longer: int = 12, alike: float = 0.55, dim: int = 256) -> DataFrame:
    """CLOSED rows of a stream of messages (session_id, message_id, content, ts), one when a session has paused for `gap`.

    The row is the trigger of what follows a session (summaries, memories); its names and clusters are those that the batch
    operators find over the session's messages. Messages later than the watermark are dropped; a session that goes on after it closed is a new one. Needs the
    state store PROVIDER, which is set in the session.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    gap_ms = int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00+00:00' + interval {gap})").first()[0])
    rows = messages.withWatermark("ts", late).select(F.col("session_id").cast("long").alias("session_id"), F.col("message_id").cast("long").alias("message_id"), "content", "ts", entities(F.col("content")).alias("names"))
    return rows.groupBy("session_id").transformWithStateInPandas(SessionState(gap_ms, most, keep, longer, alike, dim), CLOSED, "Append", "EventTime")
