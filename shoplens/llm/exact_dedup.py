"""Exact duplicates by a tree merge of sorted digest runs.

Rows are dealt to runs by a hash of their id and digest. A run keeps one entry
per digest: its best row and how many rows it stands for. In every round the
runs that differ in one digit of their number exchange entries by that digit of
the digest and merge what they get, in order of the digest. After as many
rounds as a run number has digits, each run holds one range of digests, merged
over all rows. The answers then go the same way back, from merged entries to
the entries they came from, and at last to the rows.

A digest with a third of all rows is one entry per run from the start, and on
the way back no entry answers more than `fan_in` others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import id_and_text, in_one_column
from shoplens.session import materialize

BLANKS = " \t\n\x0b\x0c\r"


def _digit(number: Column, place: int, fan_in: int) -> Column:
    return F.floor(number / F.lit(fan_in ** place)).cast("int") % fan_in


def _shape(wanted: int, most: int) -> tuple[int, int]:
    """Rounds, and the least fan-in with which so many give `wanted` runs.

    Every run is a task and a file in every round, so there are no more than needed.
    """
    digits = 1
    while most ** digits < wanted:
        digits += 1
    return digits, next(n for n in range(min(2, most), most + 1) if n ** digits >= wanted)


def _merged(entries: DataFrame) -> DataFrame:
    """One entry per run and digest, after checking that the texts behind it agree."""
    checked = F.when(F.min("check") == F.max("check"), F.min("check")).otherwise(
        F.raise_error(F.lit("one digest stands for two texts")))
    return entries.groupBy("run", "digest").agg(
        F.max("best").alias("best"), F.sum("n").alias("n"), checked.alias("check"))


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            fan_in: int = 8, runs: int | None = None) -> DataFrame:
    """Each row's digest, the row of its group that stays, and the group's size.

    Texts are equal when identical without the characters of BLANKS; null is
    empty. The row with the most code points in its original text stays, then
    the smallest id; a null id comes last. Of rows repeated with id and text
    exactly one is kept. Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    spark = docs.sparkSession
    wanted = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits, fan_in = _shape(wanted, fan_in)
    n_runs = fan_in ** digits
    bare = F.translate("text", BLANKS, "")
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.length("text").alias("n_chars"), bare.alias("bare")).select(
        "doc_id", "n_chars", F.unhex(F.sha2(F.col("bare").cast("binary"), 256)).alias("digest"),
        F.struct(F.length("bare").alias("length"), F.xxhash64("bare").alias("hash")).alias("check"))
    # Bitwise not turns the order of ids around without leaving the range of longs.
    rows = materialize(rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_runs)).cast("int")), "digests")
    level = _merged(rows.select("run", "digest", "check", F.lit(1).cast("long").alias("n"), F.struct(
        "n_chars", F.bitwise_not("doc_id").alias("inverse")).alias("best")))
    level = materialize(level, "runs")
    # 28 bits of the digest; more runs than that are never asked for
    bits = F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("int")
    levels, goals = [level], []
    for place in range(digits):
        step = fan_in ** place
        goal = (F.col("run") + (_digit(bits, place, fan_in) - _digit(F.col("run"), place, fan_in)) * step).cast("int")
        moved = level.withColumn("run", goal).repartitionById(n_runs, F.col("run")).sortWithinPartitions("run", "digest")
        level = _merged(moved)
        if place + 1 < digits:  # the last one is read once
            level = materialize(level, "runs")
        levels.append(level)
        goals.append(goal)
    answers = levels[-1].select("run", "digest", "best", "n")
    for below, goal in zip(reversed(levels[:-1]), reversed(goals)):
        asked = below.select(F.col("run").alias("from"), "digest", goal.alias("run"))
        answers = asked.join(answers, ["run", "digest"]).select(
            F.col("from").alias("run"), "digest", "best", "n")
    again = F.row_number().over(Window.partitionBy("run", "digest", "doc_id").orderBy(F.desc("n_chars")))
    keep_id = F.bitwise_not("best.inverse")
    return rows.drop("check").join(answers, ["run", "digest"]).withColumn("again", again).select(
        "doc_id", keep_id.alias("keep_id"), F.col("n").alias("group_size"),
        (keep_id.eqNullSafe(F.col("doc_id")) & (F.col("n_chars") == F.col("best.n_chars"))
         & (F.col("again") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; rows repeated whole stay once."""
    stay = keepers(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    digest = F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)
    joined = in_one_column(docs).withColumn("own", digest).join(
        stay, F.col("row")[id_col].cast("long").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("text_sha256")))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc(F.length(text))))
    return joined.withColumn("first", first).where("first = 1").select("row.*")


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
b AS (SELECT *, first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM b
"""
