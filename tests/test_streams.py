import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoplens.operators.behavior import recent_n_per_user
from shoplens.operators.dedup import first_n
from shoplens.plans import queries_ops
from shoplens.streaming import streams as st

SCHEMA = "eventId long, ts timestamp_ntz, userId string, eventType string"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Write batches as files; the stream takes one file per micro-batch, oldest first."""
    def build(batches):
        source = str(tmp_path / "source")
        for number, batch in enumerate(batches):
            (spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append")
                  .parquet(f"{source}/b={number}"))
        return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                .option("recursiveFileLookup", True).parquet(source))
    return build


def run(spark, tmp_path, stream):
    out = str(tmp_path / "out")
    st.run_to_table(stream, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


def test_dedup_replay_and_late(spark, tmp_path, feed):
    first = [(i, at(i), "u", "view") for i in range(5)]
    stream = feed([first, [*first, (9, at(600), "u", "view")], [(9, at(600), "u", "view")]])
    got = run(spark, tmp_path, st.stream_dedup_events(stream, ["eventId"]))
    assert sorted(r.eventId for r in got.collect()) == [0, 1, 2, 3, 4, 9]


def test_counts_drop_only_late_rows(spark, tmp_path, feed):
    stream = feed([[(1, at(1), "u", "view"), (2, at(2), "u", "view"), (3, at(130), "u", "view")],
                   [(4, at(100), "u", "view")], [(5, at(3), "u", "view")],
                   [(6, at(400), "u", "purchase")]])
    counts = st.stream_event_counts(stream, "5 minutes", delay="1 hour")
    got = {(r.window_start, r.eventType): r.n for r in run(spark, tmp_path, counts).collect()}
    # Minute 100 is within the hour; minute 3 came after its window was closed.
    assert got == {(at(0), "view"): 2, (at(100), "view"): 1, (at(130), "view"): 1}


def test_sliding_counts(spark, tmp_path, feed):
    stream = feed([[(1, at(7), "u", "view"), (2, at(300), "u", "view")]])
    got = run(spark, tmp_path, st.stream_event_counts(stream, "5 minutes", "1 minute"))
    assert sorted(r.window_start for r in got.collect()) == [at(m) for m in range(3, 8)]


def test_recent_n_equals_batch(spark, tmp_path, feed):
    rows = [(i, at(i * 7 % 400), "hot" if i % 3 else f"u{i % 5}", "view") for i in range(300)]
    stream = feed([rows[:120], rows[120:200], rows[200:]])
    out = str(tmp_path / "recent")

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    recent = st.stream_recent_n(stream, 4, 30, delay="30 days")
    (recent.writeStream.outputMode("update").foreachBatch(save)
           .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
           .start().awaitTermination())
    last = first_n(spark.read.parquet(f"{out}/rows"), ["userId"], [F.desc("batch")], 1)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn(
        "timestamp", F.unix_millis(F.col("ts").cast("timestamp")))
    want = {}
    for r in recent_n_per_user(batch, 4).orderBy("recency").collect():
        want.setdefault(r.userId, []).append(str(r.eventId))
    assert {r.userId: r.event_ids.split(",") for r in last.collect()} == want


def test_sessions_split_on_silence(spark, tmp_path, feed):
    rows = [(1, at(0), "u", "USER"), (2, at(10), "u", "ASSISTANT"), (3, at(90), "u", "USER"),
            (4, at(900), "u", "USER")]
    messages = feed([rows]).select(
        F.col("userId").alias("actorId"), F.lit("s").alias("sessionId"),
        F.col("eventType").alias("role"), F.col("eventId").cast("string").alias("content"),
        F.col("eventId").alias("turn"), "ts")
    got = run(spark, tmp_path, st.stream_sessions(messages, "30 minutes")).orderBy("started")
    assert [(r.n_events, r.firstPrompt) for r in got.collect()] == [(2, "1"), (1, "3")]


@pytest.mark.parametrize("files", [1, 3])
def test_sessions_of_a_table_of_several_files(spark, tmp_path, files):
    """A table may be one file or a folder of files of any name."""
    path = str(tmp_path / "conversations.parquet")
    rows = spark.range(40).selectExpr("id div 4 conv_id", "cast(id % 4 as int) turn", "'user' role",
                                      "concat('text ', id) text").repartition(files)
    if files == 1:
        rows.toPandas().astype({"turn": "int32"}).to_parquet(path, index=False)
    else:
        rows.write.parquet(path)
    got = queries_ops._stream_sessions(spark, str(tmp_path)).collect()
    assert sorted((r.sessionId, r.n_events, r.firstPrompt) for r in got) == sorted(
        (f"session-{c}", 4, f"text {4 * c}") for c in range(9))
