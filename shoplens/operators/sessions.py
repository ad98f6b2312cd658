"""Conversation sessions: summaries and timelines.

Message rows are `(actorId, sessionId, role, content, timestamp, turn)`, the
timestamp in epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoplens.operators.dedup import first_n

SESSION = ["actorId", "sessionId"]
ORDER = ["timestamp", "turn"]
PROMPT_CHARS = 200
HOURS_48_MS = 48 * 60 * 60 * 1000


def valid_messages(events: DataFrame) -> DataFrame:
    """Messages with role and content, role in lower case."""
    return (events.filter((F.coalesce(F.col("role"), F.lit("")) != "")
                          & (F.coalesce(F.col("content"), F.lit("")) != ""))
            .withColumn("role", F.lower("role")))


def _at() -> Column:
    return F.struct(*ORDER)


def first_prompt(events: DataFrame) -> DataFrame:
    """First user message per session, 200 characters, blank if there is none."""
    is_user = F.upper("role") == "USER"
    text = F.substring(F.coalesce(F.col("content"), F.lit("")), 1, PROMPT_CHARS)
    return events.groupBy(*SESSION).agg(
        F.coalesce(F.min_by(F.when(is_user, text), F.when(is_user, _at())),
                   F.lit("")).alias("firstPrompt"))


def session_rollup(events: DataFrame) -> DataFrame:
    """First prompt, first and last time and message count per session, in one aggregate."""
    is_user = F.upper("role") == "USER"
    text = F.substring(F.coalesce(F.col("content"), F.lit("")), 1, PROMPT_CHARS)
    return events.groupBy(*SESSION).agg(
        F.min("timestamp").alias("createdAt"),
        F.max("timestamp").alias("lastEventAt"),
        F.count("*").alias("n_events"),
        F.coalesce(F.min_by(F.when(is_user, text), F.when(is_user, _at())),
                   F.lit("")).alias("firstPrompt"))


def recent_sessions_filter(sessions: DataFrame, since_ms: int,
                           max_sessions: int | None = None) -> DataFrame:
    """Per actor the newest sessions active since `since_ms`, 20 unless the caller says how many."""
    limit = 20 if max_sessions is None else max_sessions
    active = sessions.filter(F.col("lastEventAt") >= since_ms)
    return first_n(active, ["actorId"], [F.desc("lastEventAt"), F.asc("sessionId")], limit,
                   rank="place")


def list_sessions(events: DataFrame, since_ms: int, max_sessions: int | None = None) -> DataFrame:
    """Recent sessions of all actors; anonymous actors have none."""
    named = events.filter((F.col("actorId") != "") & (F.col("actorId") != "anonymous"))
    return recent_sessions_filter(session_rollup(named), since_ms, max_sessions)


def session_history(events: DataFrame, max_results: int | None = None) -> DataFrame:
    """The first messages of each session, oldest first, 50 by default."""
    limit = 50 if max_results is None else max_results
    return first_n(valid_messages(events), SESSION, [F.asc(c) for c in ORDER], limit,
                   rank="position")


def recent_events_text(events: DataFrame, n: int = 10) -> DataFrame:
    """Last n messages with text per session."""
    texts = events.filter(F.coalesce(F.col("content"), F.lit("")) != "")
    return first_n(texts, SESSION, [F.desc(c) for c in ORDER], n, rank="recency")


def session_timeline(events: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """All messages of all sessions with position and delay since the one before.

    Sessions are cut into time buckets, so a session with a third of all rows is
    sorted by many tasks. Two short windows over the bucket totals carry the
    position and the last time from one bucket to the next.
    """
    messages = valid_messages(events).withColumn(
        "_bucket", F.floor(F.col("timestamp") / bucket_ms))
    part = [*SESSION, "_bucket"]
    totals = messages.groupBy(*part).agg(F.count("*").alias("_n"),
                                         F.max("timestamp").alias("_last"))
    over = Window.partitionBy(*SESSION).orderBy("_bucket")
    carried = totals.select(
        *part,
        (F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .alias("_before"),
        F.lag("_last").over(over).alias("_carry"))
    inside = Window.partitionBy(*part).orderBy(*ORDER)
    return (messages.join(carried, part)
            .withColumn("position", F.col("_before") + F.row_number().over(inside))
            .withColumn("delay_ms", F.col("timestamp")
                        - F.coalesce(F.lag("timestamp").over(inside), F.col("_carry")))
            .drop("_bucket", "_before", "_carry"))
