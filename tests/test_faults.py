"""Inputs that once gave wrong results."""

import random

import pytest
from pyspark.sql import functions as F

from shoplens.functions import clean, text as tx
from shoplens.operators import joins, ledger
from shoplens.operators.numbering import marked, marks, numbered
from shoplens.plans import jobs
from shoplens.sources import files, sinks


def test_notes_of_another_actor_stay_private(spark):
    notes = spark.createDataFrame([("/preferences/a/", "1", "secret of a"), ("/preferences/b/", "1", "note of b")],
                                  "namespace string, noteId string, text string")
    asked = spark.createDataFrame([("q", "b", "note")], "query_id string, actorId string, query string")
    found = jobs.recall_context(notes, asked, 16).collect()
    assert [(r.key, r.text) for r in found] == [("1", "note of b")]


def test_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,TITLE,PRICE\n1,"a ""b"", c",3\n')
    row, = files.read_entity_csv(spark, str(tmp_path)).collect()
    assert tuple(row) == ("1", 'a "b", c', "3")


def test_all_white_space_is_trimmed(spark):
    df = spark.createDataFrame([("\t x ",), ("\t ",)], "c string")
    assert [r[0] for r in df.select(clean.text_or_null(F.col("c"))).collect()] == ["x", None]


def test_values_out_of_range_do_not_end_the_job(spark):
    df = spark.createDataFrame([("1e13", 1 << 60)], "m string, timestamp long").withColumns({
        "eventType": F.lit("view"), "itemId": F.lit("i"), "quantity": F.lit(1), "price": F.lit("1"),
        "recommendationId": F.lit("")})
    row = df.select(tx.money(F.col("m")).alias("m"), tx.format_event_line().alias("line")).first()
    assert row.m == "10000000000000.00" and row.line.startswith("- ?: view i")


def test_stale_keys_do_not_complete_a_run(spark):
    chunks = spark.createDataFrame([("r", "a"), ("r", "b")], "run string, inputKey string")
    states = spark.createDataFrame([("r", "t", 1, "a", "Completed"), ("r", "t", 1, "old", "Completed")],
                                   "run string, dataType string, startedAt int, inputKey string, status string")
    row, = ledger.run_ledger(chunks, states).collect()
    assert (row.submitted_chunks, row.complete) == (1, False)


@pytest.mark.parametrize(("n", "parts"), [(0, 1), (1, 3), (500, 2), (2000, 7), (2001, 5)])
def test_chunks_are_full_but_for_the_last(spark, tmp_path, n, parts):
    df = spark.range(0, n, 1, parts).select(F.col("id").cast("string").alias("line"))
    written = sinks.write_request_chunks(df, str(tmp_path / "out"), chunk_size=500)
    files_ = sorted((tmp_path / "out").glob("part-*"))
    assert len(files_) == written == max(1, -(-n // 500))
    lines = [p.read_text().splitlines() for p in files_]
    assert all(len(x) == 500 for x in lines[:-1]) and len(lines[-1]) == (n - 1) % 500 + 1 if n else not lines[0]
    assert sorted(int(x) for chunk in lines for x in chunk) == list(range(n))


def test_small_chunks_share_a_task(spark, tmp_path):
    df = spark.range(0, 20010, 1, 3).select(F.col("id").cast("string").alias("line"))
    assert sinks.write_request_chunks(df, str(tmp_path / "out"), chunk_size=20) == 1001
    files_ = sorted(p.name for p in (tmp_path / "out").glob("part-*"))
    assert len(files_) == 1001 and len({name[:10] for name in files_}) <= 2 * spark.sparkContext.defaultParallelism
    lines = [len((tmp_path / "out" / name).read_text().splitlines()) for name in files_]
    assert lines == [20] * 1000 + [10]


def test_numbers_are_consecutive(spark):
    df = spark.range(0, 1000, 1, 6).filter("id % 6 <> 3 and id > 200")
    rows, total = numbered(df, "n")
    got = [r.n for r in rows.collect()]
    assert total == df.count() and sorted(got) == list(range(total))


def test_marks_let_all_wanted_keys_through(spark):
    keys = spark.range(300).selectExpr("cast(id * 7 as string) key").union(spark.createDataFrame([(None,)], "key string"))
    every = spark.range(5000).selectExpr("cast(id as string) key")
    left = every.filter(marked(F.col("key"), marks(keys)))
    assert left.join(keys, "key").count() == 300 and left.count() < 320
    assert every.filter(marked(F.col("key"), marks(keys.limit(0)))).count() == 0


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_quoted_line_breaks_over_splits(spark, tmp_path, split):
    """The same rows as an unsplit read, by many tasks, wherever the splits fall."""
    rng = random.Random(split)
    def cell():  # noqa: E306
        kind = rng.random()
        text = "".join(rng.choice("ab ,\n") for _ in range(rng.randrange(12)))
        return '"' + text.replace("b", '""') + '"' if kind < 0.5 else text.replace("\n", "").replace(",", "")
    for name, n in (("a.csv", 200), ("b.csv", 1), ("c.csv", 0)):
        rows = [f"{i},{cell()},{cell()}" for i in range(n)] + (['7,"long' + "\nline" * 300 + '",x', "8,short"] if n else [])
        end = "\r\n" if name == "b.csv" else "\n"
        (tmp_path / name).write_bytes(("ID,TITLE,NOTE" + end + end.join(rows) + (end if n else "")).encode())
    options = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    want = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="bad").schema(
        "ID string, TITLE string, NOTE string, bad string").csv(str(tmp_path)).select("ID", "TITLE", "NOTE").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        read = files.read_messy_csv(spark, str(tmp_path), multi_line=True)
        got = read.collect()
        if split == 64:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, map(tuple, want)))
    assert {r.ID for r in got if r[files.BAD]} == {"8"}
    (tmp_path / "d.csv").write_text("ID,OTHER,NOTE\n1,2,3\n")
    with pytest.raises(Exception, match="another CSV header"):
        files.read_messy_csv(spark, str(tmp_path), multi_line=True).collect()


def test_metadata_maps_are_never_broadcast(spark, rows):
    raw = spark.range(50).select(F.col("id").cast("string").alias("key"),
                                 F.create_map(F.lit("a"), F.col("id").cast("string")).alias("metadata"))
    some = spark.range(45, 55).select(F.col("id").cast("string").alias("key"), F.array(F.lit(1.0)).alias("vector"))
    strict, lenient = joins.enrich_vectors_strict(some, raw), joins.enrich_vectors(some, raw)
    assert [r[0] for r in rows(strict)] == ["45", "46", "47", "48", "49"]
    assert dict(r[::2] for r in rows(lenient)) == {
        **{str(i): {"a": str(i)} for i in range(45, 50)}, **{str(i): {"id": str(i)} for i in range(50, 55)}}
    for df in (strict, lenient):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
