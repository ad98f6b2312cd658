"""Registered queries: run ledger, log metrics, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoplens import fixed
from shoplens.operators import ledger as lg, logs as lo
from shoplens.operators.dedup import first_n
from shoplens.plans import tables as t
from shoplens.plans.registry import query
from shoplens.session import work_dir
from shoplens.sources.index_store import Index
from shoplens.streaming import streams as st


# --- ledger -----------------------------------------------------------------

def _submitted(spark, d) -> DataFrame:
    return t.jobs(spark, d).join(t.chunks(spark, d).filter("submitted"), ["run", "inputKey"],
                                 "left_semi")


@query("remaining_chunks", "SELECT run, inputKey FROM jobs WHERE NOT submitted")
def _remaining_chunks(spark, d):
    return lg.remaining_chunks(t.chunks(spark, d).drop("submitted"), _submitted(spark, d))


_STATES = """SELECT run, bool_and(status <> 'InProgress') AS all_complete,
    bool_or(status = 'Failed') AS any_failed, count(*) AS jobs,
    count(*) FILTER (status = 'Completed') AS completed,
    count(*) FILTER (status = 'Failed') AS failed,
    count(*) FILTER (status = 'InProgress') AS open FROM jobs"""


@query("run_status_rollup", f"{_STATES} GROUP BY run")
def _run_status_rollup(spark, d):
    return lg.run_status_rollup(t.jobs(spark, d))


_LEDGER = f"""SELECT c.run, total_chunks, coalesce(s.jobs, 0) AS submitted_chunks,
    coalesce(s.jobs, 0) >= total_chunks AS complete, all_complete, any_failed
    FROM (SELECT run, count(*) AS total_chunks FROM jobs GROUP BY run) c
    LEFT JOIN ({_STATES} WHERE submitted GROUP BY run) s ON s.run = c.run"""


@query("run_ledger", _LEDGER)
def _run_ledger(spark, d):
    return lg.run_ledger(t.chunks(spark, d), _submitted(spark, d)).select(
        "run", "total_chunks", "submitted_chunks", "complete", "all_complete", "any_failed")


@query("latest_run_per_type", """
    SELECT dataType, max(startedAt) AS startedAt, 'run-' || max(startedAt) AS run FROM jobs
    GROUP BY dataType""")
def _latest_run_per_type(spark, d):
    return lg.latest_run_per_type(t.jobs(spark, d))


@query("publishable_runs", f"""
    SELECT m.dataType, l.run FROM ({_LEDGER}) l JOIN (SELECT dataType, 'run-' || max(startedAt)
      AS run FROM jobs GROUP BY dataType) m ON m.run = l.run
    WHERE complete AND all_complete AND NOT any_failed""")
def _publishable_runs(spark, d):
    ledger = lg.run_ledger(t.chunks(spark, d), _submitted(spark, d))
    return lg.publishable_runs(ledger, t.jobs(spark, d)).select("dataType", "run")


# --- logs -------------------------------------------------------------------

def _metrics_sql(minutes: int, base: int) -> str:
    """Windows of `minutes`; cache totals are differenced per process and window of `base` minutes."""
    big, small = (f"epoch_us(ts) // {m * 60_000_000} * {m * 60}" for m in (minutes, base))
    return f"""SELECT *, {minutes} AS minutes, round(errors / nullif(requests, 0), 6) AS error_rate,
      round(blocked / nullif(requests, 0), 6) AS block_rate,
      round(prompt_fallbacks / nullif(prompt_loads + prompt_fallbacks, 0), 6) AS prompt_fallback_rate,
      (SELECT round(sum(h) / nullif(sum(h) + sum(m), 0), 6) FROM (
        SELECT s // {minutes * 60} * {minutes * 60} AS t, CASE WHEN hi >= hb THEN hi - hb ELSE hi END AS h,
          CASE WHEN mi >= mb THEN mi - mb ELSE mi END AS m
        FROM (SELECT *, coalesce(lag(hi) OVER w, lo) AS hb, coalesce(lag(mi) OVER w, ml) AS mb FROM (
            SELECT {small} AS s, process, min(p).hits AS lo, max(p).hits AS hi,
              min(p).misses AS ml, max(p).misses AS mi
            FROM (SELECT *, {{'hits': hits, 'misses': misses}} AS p FROM parsed) WHERE hits IS NOT NULL GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY process ORDER BY s))) WHERE t = window_start) AS cache_hit_rate
    FROM (SELECT {big} AS window_start, count(lat) AS requests,
      count(*) FILTER (line LIKE '%tool=%') AS tool_calls,
      count(*) FILTER (line LIKE '%Output blocked%') AS blocked,
      count(*) FILTER (line LIKE '%Loaded from%') AS facet_loads,
      count(*) FILTER (line LIKE '%using fallback%') AS facet_fallbacks,
      count(*) FILTER (line LIKE '%[prompts] Loaded%') AS prompt_loads,
      count(*) FILTER (line LIKE '%DDB read failed%') AS prompt_fallbacks,
      count(*) FILTER (line LIKE '%status=503%') AS errors,
      quantile_disc(lat, 0.5) AS latency_p50_ms, quantile_disc(lat, 0.95) AS latency_p95_ms,
      quantile_disc(lat, 0.99) AS latency_p99_ms FROM parsed GROUP BY 1)"""


_PARSED = """parsed AS (SELECT ts, process, line,
    TRY_CAST(regexp_extract(line, 'responseTime=([0-9]+)', 1) AS BIGINT) AS lat,
    TRY_CAST(regexp_extract(line, 'hits=([0-9]+)', 1) AS BIGINT) AS hits,
    TRY_CAST(regexp_extract(line, 'misses=([0-9]+)', 1) AS BIGINT) AS misses FROM logs)"""


@query("log_metrics", f"WITH {_PARSED} {_metrics_sql(360, 360)}")
def _log_metrics(spark, d):
    return lo.log_metrics(t.log_lines(spark, d), 360).withColumn(
        "window_start", F.col("window_start").cast("long"))


@query("tool_counts", """SELECT regexp_extract(line, 'tool=([a-z_]+)', 1) AS tool, count(*) AS calls
    FROM logs WHERE line LIKE '%tool=%' GROUP BY 1""")
def _tool_counts(spark, d):
    return lo.tool_counts(t.log_lines(spark, d))


@query("alert_rules", f"WITH {_PARSED} " + " UNION ALL ".join(
    f"""SELECT window_start, minutes, '{m}' AS metric, CAST({m} AS DOUBLE) AS value,
    CAST({limit} AS DOUBLE) AS threshold, '{severity}' AS severity
    FROM ({_metrics_sql(minutes, 5)}) WHERE {m} {sign} {limit}"""
    for m, sign, limit, minutes, severity in fixed.ALERT_RULES))
def _alert_rules(spark, d):
    return lo.alert_rules(t.log_lines(spark, d)).withColumn(
        "window_start", F.col("window_start").cast("long"))


# --- streams ----------------------------------------------------------------

def file_stream(spark, d, name: str) -> DataFrame:
    """A table as a file stream, be it one file or a folder of files.

    A stream takes a plain path for a folder; a pattern may also be that of one file.
    """
    return spark.readStream.schema(t.table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def event_stream(spark, d) -> DataFrame:
    """The events as a file stream."""
    return _interactions_of(file_stream(spark, d, "events"))


def _interactions_of(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "event_id eventId", "ts", "cast(user_id as string) userId",
        "get_json_object(props, '$.k') itemId",
        "case when event_type = 'click' then 'add_to_cart' else event_type end eventType")


@query("stream_dedup_events", "SELECT eventId, userId, itemId FROM inter")
def _stream_dedup_events(spark, d):
    """All events arrive twice; each is kept once."""
    source, out = work_dir(spark, "replayed"), work_dir(spark, "stream-dedup")
    rows = t.table(spark, d, "events")
    rows.unionByName(rows).write.parquet(source)
    stream = _interactions_of(spark.readStream.schema(rows.schema).parquet(source))
    unique = st.stream_dedup_events(stream, ["eventId"]).select("eventId", "userId", "itemId")
    st.run_to_table(unique, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


_CLOSED = "(SELECT max(epoch_us(ts)) // 1000000 - 3600 FROM inter)"


@query("stream_event_counts", f"""
    SELECT window_start, eventType, n FROM (SELECT "timestamp" // 300 * 300 AS window_start,
      eventType, count(*) AS n FROM inter GROUP BY ALL) WHERE window_start + 300 <= {_CLOSED}""")
def _stream_event_counts(spark, d):
    """Five-minute counts; the windows the watermark has not passed stay open."""
    out = work_dir(spark, "stream-counts")
    st.run_to_table(st.stream_event_counts(event_stream(spark, d)), f"{out}/rows",
                    f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select(
        F.col("window_start").cast("long").alias("window_start"), "eventType", "n")


@query("stream_sessions", f"""
    SELECT actorId, sessionId, max("timestamp") // 1000 AS last_event, count(*) AS n_events,
      coalesce(arg_min(substr(content, 1, 200), turn) FILTER (role = 'USER'), '') AS firstPrompt
    FROM msgs GROUP BY actorId, sessionId
    HAVING max("timestamp") // 1000 + 1800 <= (SELECT max("timestamp") // 1000 - 3600 FROM msgs)""")
def _stream_sessions(spark, d):
    out = work_dir(spark, "stream-sessions")
    messages = file_stream(spark, d, "conversations").selectExpr(
        "concat('actor-', conv_id % 20) actorId", "concat('session-', conv_id) sessionId",
        "upper(role) role", "text content", "turn",
        f"timestamp_millis({t.BASE_MS} + conv_id * 7200000 + turn * 1500000) ts")
    st.run_to_table(st.stream_sessions(messages), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select(
        "actorId", "sessionId", F.col("last_event").cast("long").alias("last_event"), "n_events",
        "firstPrompt")


@query("stream_recent_n", """
    SELECT userId, string_agg(CAST(eventId AS VARCHAR), ',' ORDER BY rn) AS event_ids FROM (
      SELECT userId, eventId, row_number() OVER (PARTITION BY userId
        ORDER BY epoch_us(ts) // 1000 DESC, eventId DESC) AS rn FROM inter) WHERE rn <= 10
    GROUP BY userId""")
def _stream_recent_n(spark, d):
    out = work_dir(spark, "stream-recent")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    recent = st.stream_recent_n(event_stream(spark, d), 10, 3650)
    run = (recent.writeStream.outputMode("update").foreachBatch(save)
           .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    run.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return first_n(rows, ["userId"], [F.desc("batch")], 1).select("userId", "event_ids")


@query("stream_index_upsert", """
    SELECT key, CASE WHEN label < 3 THEN 'changed' ELSE 'first' END AS state FROM vecs
    WHERE label <> 3""")
def _stream_index_upsert(spark, d):
    """A stream of creates, then updates of labels 0-2 and deletes of label 3."""
    out = work_dir(spark, "stream-index")
    rows = t.vectors(spark, d)

    def change(picked: DataFrame, op: str, state: str, seq: int) -> DataFrame:
        return picked.select("key", "vector", F.create_map(F.lit("state"), F.lit(state))
                             .alias("metadata"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))

    changes = (change(rows, "create", "first", 1)
               .unionByName(change(rows.filter("label < 3"), "update", "changed", 2))
               .unionByName(change(rows.filter("label = 3"), "delete", "gone", 2)))
    changes.write.parquet(f"{out}/changes")
    stream = spark.readStream.schema(changes.schema).parquet(f"{out}/changes")
    index = Index(spark, f"{out}/index", "products")
    st.stream_index_upsert(stream, index, f"{out}/checkpoint").awaitTermination()
    return index.scan().select("key", F.col("metadata")["state"].alias("state"))
