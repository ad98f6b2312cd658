"""Readers for CSV, JSON arrays and JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

BAD = "_corrupt_record"


def read_entity_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns. No inference pass, so ids keep leading zeros.

    Quotes are doubled inside quoted values. Files with another header fail.
    """
    return spark.read.options(header=True, escape='"', enforceSchema=False).csv(path)


def read_messy_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Tolerant CSV: padding trimmed, ragged rows kept and flagged in `_corrupt_record`.

    `multi_line` is for quoted line breaks. Such files are split as well: see `csv_records`.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "enforceSchema": False,
               "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    header = spark.read.options(**options).csv(path).columns
    fields = [T.StructField(h, T.StringType()) for h in header]
    schema = T.StructType([*fields, T.StructField(BAD, T.StringType())])
    if not multi_line:
        return (spark.read.options(**options)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
                .schema(schema).csv(path))
    shape = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
             "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "maxCharsPerColumn": "-1"}
    row = F.from_csv("value", schema.toDDL(), shape)
    same = F.lit(True)
    for i, name in enumerate(header):
        same = same & F.col("row")[header[i]].eqNullSafe(F.lit(name))
    other = F.raise_error(F.concat(F.lit("another CSV header: "), F.col("value"))).cast("boolean")
    rows = csv_records(spark, path).withColumn("row", row)
    return rows.filter(F.when(F.col("is_header"), F.when(same, F.lit(False)).otherwise(other)).otherwise(
        F.lit(True))).select("row.*")


_PIECES = "file string, block long, kind int, is_header boolean, value string"
_WHOLE, _HEAD, _INSIDE, _TAIL = 0, 1, 2, 3


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """`(value, is_header)`: the records of CSV files whose quoted values may hold line breaks.

    Files are read in splits, as lines. A line starts a record when the number of
    quotes before it in the file is even. That is known in three steps: quotes
    per split, their sums over the splits before it (a row per split), and the
    lines of a split in order. Records inside a split never move; only the
    pieces of one that crosses splits are brought together. The first record of
    a file is its header. Blank records are dropped; values must quote properly.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    counts = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside"))
    rows = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "quotes", "inside")
    pieces = rows.mapInArrow(_cut_records, _PIECES)
    # A piece belongs to the record that the last split before it left open.
    by_file = Window.partitionBy("file").orderBy("block", "kind")
    opened = F.last(F.when(F.col("kind") == _TAIL, F.col("block")), ignorenulls=True)
    crossing = pieces.filter(F.col("kind") > _WHOLE).withColumn(
        "record", opened.over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = crossing.groupBy("file", "record").agg(
        F.array_join(F.transform(ordered, lambda p: p["value"]), "\n").alias("value"), F.bool_or("is_header").alias("is_header"))
    whole = pieces.filter(F.col("kind") == _WHOLE).select("value", "is_header")
    text = F.replace(F.regexp_replace("value", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    return whole.union(joined.select("value", "is_header")).withColumn("value", text).filter(F.trim("value") != "")


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order, to records and the pieces of records that cross a split.

    A split's piece is its head (the end of a record from before), its tail (the
    start of one that goes on), or all of it when no record starts there.
    """
    now, odd, held, head, first = None, False, [], False, False

    def piece(ended: bool) -> tuple:
        kind = (_HEAD if ended else _INSIDE) if head else (_WHOLE if ended else _TAIL)
        return (*now, kind, first, "\n".join(held))

    for batch in batches:
        out = []
        files, blocks, inside = (batch.column(c) for c in ("file", "block", "inside"))
        quotes = np.asarray(batch.column("quotes")) % 2
        values = batch.column("value")
        changes = np.flatnonzero(np.append(True, (pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(
            zero_copy_only=False) | (np.diff(np.asarray(blocks)) != 0)))) if len(files) else []
        for start, stop in zip(changes, [*changes[1:], len(files)]):
            place = (files[int(start)].as_py(), blocks[int(start)].as_py())
            if place != now:
                if held:
                    out.append(piece(False))
                now, odd, held = place, bool(inside[int(start)].as_py()), []
                head, first = odd, place[1] == 0 and not odd
            at = int(start)
            before = (np.cumsum(quotes[start:stop]) - quotes[start:stop] + odd) % 2
            special = np.flatnonzero((before == 1) | (quotes[start:stop] == 1)) + at
            if first:
                special = np.union1d(special, [at])
            for i in special.tolist():
                if i > at and not odd:      # lines that are records of their own
                    yield _whole(now, values.slice(at, i - at))
                held.append(values[i].as_py())
                odd ^= bool(quotes[i])
                if not odd:
                    out.append(piece(True))
                    held, head, first = [], False, False
                at = i + 1
            if at < stop:
                yield _whole(now, values.slice(at, int(stop) - at))
        yield _piece_rows(out)
    if held:
        yield _piece_rows([piece(False)])


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["file", "block", "kind", "is_header", "value"])


def _whole(place: tuple[str, int], values: pa.Array) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays(
        [pa.array([place[0]] * n, pa.string()), pa.array(np.full(n, place[1])), pa.array(np.zeros(n, np.int32)),
         pa.array(np.zeros(n, bool)), values], ["file", "block", "kind", "is_header", "value"])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType,
                       pattern: str | None = None) -> DataFrame:
    """JSON lines with the unreadable ones kept aside.

    Blank lines are dropped and malformed UTF-8 is replaced. A line that does
    not parse has null fields and its text in `_corrupt_record`.
    """
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    found = {"pathGlobFilter": pattern, "recursiveFileLookup": True} if pattern else {}
    lines = spark.read.options(**found).text(path).select(F.make_valid_utf8("value").alias("line"))
    parsed = (lines.filter(F.trim("line") != "")
              .select(F.from_json("line", full, {"columnNameOfCorruptRecord": BAD}).alias("r")))
    return parsed.select("r.*")


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows and quarantined lines."""
    good = df.filter(F.col(BAD).isNull()).drop(BAD)
    return good, df.filter(F.col(BAD).isNotNull()).select(BAD)


def discover_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files under a prefix by name pattern; hidden and temporary ones are skipped."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
               .option("recursiveFileLookup", True).load(path))
    return listing.select("path", "length", "modificationTime").filter(
        ~F.col("path").contains("/_temporary/"))


def output_pattern(spark: SparkSession, path: str) -> str | None:
    """The name pattern of the result files to read below a path; None if none has such a name."""
    for pattern in ("*.jsonl.out", "*.jsonl"):
        if not discover_files(spark, path, pattern).isEmpty():
            return pattern
    return None


def discover_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Finished result files (`.jsonl.out`) if there are any, else `.jsonl`."""
    finished = discover_files(spark, path, "*.jsonl.out")
    return finished if not finished.isEmpty() else discover_files(spark, path, "*.jsonl")


def discover_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Request chunk files `part-ddddd-*.txt`."""
    found = discover_files(spark, path, "part-*.txt")
    return found.filter(F.col("path").rlike(r"(^|/)part-[0-9]{5}-[^/]+\.txt$"))
