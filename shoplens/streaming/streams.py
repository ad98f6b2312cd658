"""Structured Streaming forms of the event, session and index operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoplens.operators.dedup import dedup
from shoplens.session import materialize
from shoplens.sources.index_store import Index

SESSION_SETTINGS = {
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
# Timers and several states per key need this store.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def with_event_time(stream: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermark on a real timestamp: `timestamp_ntz` columns cannot carry one."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold while a query is started, which keeps them; the caller's come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_dedup_events(events: DataFrame, keys: list[str], column: str = "ts",
                        delay: str = "1 hour") -> DataFrame:
    """First arrival of each key; a key is forgotten once the watermark passes it."""
    return with_event_time(events, column, delay).dropDuplicatesWithinWatermark(keys)


def stream_event_counts(events: DataFrame, length: str = "5 minutes", slide: str | None = None,
                        column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts per event type."""
    window = F.window(column, length, slide) if slide else F.window(column, length)
    return (with_event_time(events, column, delay)
            .groupBy(window.alias("w"), "eventType").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "eventType", "n"))


def stream_sessions(messages: DataFrame, gap: str = "30 minutes", column: str = "ts",
                    delay: str = "1 hour") -> DataFrame:
    """Live session summaries: a session ends after a silence of `gap`.

    Started with SESSION_SETTINGS, sessions are merged inside each task first, so
    a long one shuffles one row per task.
    """
    is_user = F.upper("role") == "USER"
    at = F.struct(column, "turn")
    text = F.substring(F.coalesce(F.col("content"), F.lit("")), 1, 200)
    return (with_event_time(messages, column, delay)
            .groupBy(F.session_window(column, gap).alias("w"), "actorId", "sessionId")
            .agg(F.count("*").alias("n_events"), F.max(column).alias("last_event"),
                 F.coalesce(F.min_by(F.when(is_user, text), F.when(is_user, at)),
                            F.lit("")).alias("firstPrompt"))
            .select("actorId", "sessionId", F.col("w.start").alias("started"), "last_event",
                    "n_events", "firstPrompt"))


def stream_recent_n(events: DataFrame, n: int = 10, keep_days: int = 30, column: str = "ts",
                    delay: str = "1 hour") -> DataFrame:
    """Last n event ids per user, re-emitted on change and expired with the watermark.

    A micro-batch may hold very many events of one user, but each task sends n
    of a user at most, and the state never exceeds n. Events without an id or a
    time are left out.
    """
    expire_ms = keep_days * 86_400_000

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, ids = state.get if state.exists else ([], [])
        held = list(zip(times, ids))
        for batch in batches:
            new = batch.nlargest(n, ["_ms", "eventId"])
            found = zip(new["_ms"].tolist(), new["eventId"].tolist())
            held = sorted({*held, *found}, reverse=True)[:n]
        newest = held[0][0]
        held = [(t, i) for t, i in held if t > newest - expire_ms]
        state.update(([t for t, _ in held], [i for _, i in held]))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + expire_ms)
        yield pd.DataFrame({"userId": [key[0]], "newest_ms": [newest],
                            "event_ids": [",".join(str(i) for _, i in held)]})

    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(pa.table(batch), [
                ("userId", "ascending"), ("_ms", "descending"), ("eventId", "descending")])
            ordered = batch.take(order)
            users = pc.rank(ordered.column("userId"), "ascending", tiebreaker="min").to_numpy()
            yield ordered.filter(pa.array(np.arange(len(users)) - (users - 1) < n))

    at = F.col(column).cast("timestamp")
    rows = events.select("userId", "eventId", F.unix_millis(at).alias("_ms"), at.alias(column))
    rows = rows.filter("eventId is not null and _ms is not null")
    rows = with_event_time(rows.mapInArrow(newest, rows.schema), column, delay)
    return rows.groupBy("userId").applyInPandasWithState(
        update, "userId string, newest_ms long, event_ids string",
        "times array<long>, ids array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def apply_changes(index: Index, changes: DataFrame) -> None:
    """One batch of changes `(key, vector, metadata, op, seq)` applied to an index.

    The last change per key wins; `delete` removes the key. Applying the same
    batch again gives the same index. Only the parts with changed keys are written.
    """
    last = materialize(dedup(changes, ["key"], [F.desc("seq")],
                             tie=F.xxhash64("op", "vector", F.to_json("metadata"))), "changes")
    index.change(last.filter(F.col("op") != "delete").select("key", "vector", "metadata"),
                 last.filter(F.col("op") == "delete").select("key"))


class NewestChange(StatefulProcessor):
    """Lets a change of a key pass if its `seq` is above all earlier ones of the key.

    The state is one number per key. That of a deleted key is dropped after
    `forget_ms` without a change; until then a late older change cannot bring it back.
    """

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seq long, gone boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r.seq, r.op, str(r.vector), str(r.metadata)), default=None)
        last = self.seen.get() if self.seen.exists() else None
        if best is None or (last is not None and best.seq <= last[0]):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        gone = best.op == "delete"
        self.seen.update((best.seq, gone))
        if gone:
            self.handle.registerTimer(best.arrived_ms + self.forget_ms)
        yield Row(key=key[0], vector=best.vector, metadata=best.metadata, op=best.op, seq=best.seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_changes(changes: DataFrame, forget_days: float = 30.0) -> DataFrame:
    """The changes `(key, vector, metadata, op, seq)` that are newer than all before them, over all batches.

    Changes without a key or `seq` cannot be ordered and are left out. The clock
    of forgetting is a watermark on the time of arrival.
    """
    rows = changes.filter("key is not null and seq is not null").selectExpr(
        "cast(key as string) key", "cast(vector as array<float>) vector", "metadata", "op", "cast(seq as long) seq",
        "current_timestamp() arrived").withWatermark("arrived", "0 seconds").withColumn(
        "arrived_ms", F.unix_millis("arrived"))
    return rows.groupBy("key").transformWithState(
        NewestChange(int(forget_days * 86_400_000)),
        "key string, vector array<float>, metadata map<string,string>, op string, seq long",
        outputMode="update", timeMode="EventTime")


def stream_index_upsert(changes: DataFrame, index: Index, checkpoint: str,
                        trigger: dict | None = None, forget_days: float = 30.0):
    """Start the query that applies arriving product changes batch by batch.

    Late older changes are held back by `newest_changes`, whatever batch they come in.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply_changes(index, batch)

    with settings(changes.sparkSession, **STATE_SETTINGS):
        return (newest_changes(changes, forget_days).writeStream.outputMode("update").foreachBatch(run)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 fmt: str = "parquet"):
    """Run a stream over everything available and leave the rows in files."""
    with settings(stream.sparkSession, **SESSION_SETTINGS):
        query = (stream.writeStream.outputMode(mode).format(fmt)
                 .option("path", path).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
