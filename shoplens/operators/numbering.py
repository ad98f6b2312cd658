"""Consecutive numbers and key filters for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoplens.session import materialize

_PART = 33      # bits of a row's place in its partition in monotonically_increasing_id
MARK_BITS = 23


def numbered(df: DataFrame, name: str = "row_number", label: str = "numbered") -> tuple[DataFrame, int]:
    """The rows with consecutive numbers from 0, and their count.

    Rows are written once with their place in their partition. The counts of
    the partitions, one row each, are summed up and give every partition its
    first number; no row is sorted or moved.
    """
    held = materialize(df.withColumn(name, F.monotonically_increasing_id()), label)
    part = F.shiftright(name, _PART)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    # A row per partition of one job.
    out = held.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << _PART) - 1)))
    return out.select(held.columns), total


def marks(keys: DataFrame, key: str = "key", bits: int = MARK_BITS) -> Column:
    """A bitmap of 2**bits places with a mark for each key's hash, as a value for use in another plan.

    Its size does not depend on the data: a Bloom filter with one hash. A full
    one lets every row through and leaves the work to the join behind it.
    """
    place = _place(F.col(key), bits)
    words = keys.groupBy((place / 32).cast("int").alias("word")).agg(
        F.bit_or(_bit(place)).alias("marks"))
    every = keys.sparkSession.range(1 << (bits - 5)).select(
        F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("marks"))
    dense = words.union(every).groupBy("word").agg(F.bit_or("marks").alias("marks"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "marks")))
    return dense.select(F.transform(ordered, lambda w: w["marks"])).scalar()


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << bits)).cast("int")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))


def marked(key: Column, bitmap: Column, bits: int = MARK_BITS) -> Column:
    """Whether a key may be one of those of the bitmap."""
    place = _place(key, bits)
    return F.coalesce(F.get(bitmap, (place / 32).cast("int")).bitwiseAND(_bit(place)) != 0, F.lit(False))
