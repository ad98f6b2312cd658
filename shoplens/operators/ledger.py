"""Run ledger: chunks, job states and which run may publish.

Job rows are `(run, dataType, startedAt, inputKey, status)`, one per submitted
chunk; chunk rows are `(run, inputKey)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FAILED = ["Failed", "Stopped"]


def remaining_chunks(chunks: DataFrame, submitted: DataFrame) -> DataFrame:
    """Chunks not submitted yet, for resuming a run."""
    keys = ["run", "inputKey"]
    return chunks.join(submitted.select(*keys), keys, "left_anti")


def run_status_rollup(jobs: DataFrame) -> DataFrame:
    """Per run: all finished, any failed, and jobs per state.

    Failed and stopped jobs are finished; only other states keep a run open.
    """
    state = F.coalesce(F.col("status"), F.lit("Error"))
    done = state.isin("Completed", *FAILED)
    return jobs.groupBy("run").agg(
        F.bool_and(done).alias("all_complete"),
        F.bool_or(state.isin(FAILED)).alias("any_failed"),
        F.count("*").alias("jobs"),
        F.count_if(state == "Completed").alias("completed"),
        F.count_if(state.isin(FAILED)).alias("failed"),
        F.count_if(~done).alias("open"))


def run_ledger(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chunk totals against submitted chunks per run, with the state of its jobs."""
    totals = chunks.groupBy("run").agg(F.count("*").alias("total_chunks"))
    # Only keys that are chunks of the run count; a stale key submits nothing.
    submitted = jobs.join(chunks.select("run", "inputKey"), ["run", "inputKey"], "left_semi").groupBy("run").agg(F.count_distinct("inputKey").alias("submitted_chunks"))
    states = run_status_rollup(jobs)
    ledger = totals.join(submitted, "run", "left").join(states, "run", "left")
    count = F.coalesce(F.col("submitted_chunks"), F.lit(0))
    return ledger.withColumn("submitted_chunks", count).withColumn(
        "complete", count >= F.col("total_chunks"))


def latest_run_per_type(runs: DataFrame) -> DataFrame:
    """The newest run of each data type; only it may publish."""
    return runs.groupBy("dataType").agg(
        F.max("startedAt").alias("startedAt"),
        F.max_by("run", F.struct("startedAt", "run")).alias("run"))


def publishable_runs(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest runs whose chunks are all submitted and whose jobs all succeeded."""
    latest = latest_run_per_type(runs)
    ready = ledger.filter(F.col("complete") & F.col("all_complete") & ~F.col("any_failed"))
    return latest.join(ready, "run")
