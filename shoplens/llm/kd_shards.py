"""Shards of near equal bytes: a k-d tree over the metadata of documents.

Every cell of the tree covers a range of shards. A cell of more than one shard
is cut across its widest metadata dimension, at the place below which the share
of its bytes lies that its left shards are to get, until every cell has the
target size of one shard. The weighted median is found from sums over all rows:
the dimension is divided into 2**16 steps, the step that holds the median by a
hash of the text, and that one by a hash of the row, so a value or a text with a
third of all bytes is cut as well. Each step adds up per cell and step before
anything is shuffled.

All of it is DataFrame expressions; the text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.session import materialize

_STEPS = 1 << 16


def _position(name: str, kind: T.DataType) -> Column:
    """A value's place on its axis, as a double: numbers by magnitude, others by their first six bytes; null first."""
    value = F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        number = value.cast("double")
        number = F.when(F.isnan(number), F.lit(None)).otherwise(number)
        return F.coalesce(F.signum(number) * F.ln(1 + F.least(F.abs(number), F.lit(1e300))), F.lit(-1000.0))
    first = F.hex(F.substring(value.cast("string").cast("binary"), 1, 6))
    return F.coalesce(F.conv(F.rpad(first, 12, "0"), 16, 10).cast("double") + 1, F.lit(0.0))


def prepared(docs: DataFrame, dimensions: list[str], id_col: str = "doc_id", text_col: str = "text",
             keep: bool = False) -> DataFrame:
    """One narrow row per document, numbered by the task that wrote it; with `keep` also the whole row."""
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    axes = [_position(name, docs.schema[name].dataType).alias(f"x{i}") for i, name in enumerate(dimensions)]
    number = F.monotonically_increasing_id()
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), F.xxhash64(text).alias("h"), number.alias("number"),
        F.array(F.lit(0.0), *axes).alias("x"), *whole)
    return materialize(rows.withColumn("own", F.xxhash64("doc_id", "number")), "kd-rows")


def _step(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(_STEPS)).cast("int")


def _crossing(weights: DataFrame, step: str) -> DataFrame:
    """Of (lo, k, step, goal, size) sums the step in which the goal is reached, what is left of it, and its size."""
    by = Window.partitionBy("lo", "k").orderBy(step)
    sums = weights.withColumn("upto", F.sum("size").over(by)).where(F.col("upto") >= F.col("goal"))
    first = sums.groupBy("lo", "k").agg(F.min(F.struct(F.col(step).alias("at"), "upto", "size", "goal")).alias("c"))
    return first.select("lo", "k", F.col("c.at").alias(step), (F.col("c.goal") - F.col("c.upto") + F.col("c.size")).alias("goal"),
                        F.col("c.size").alias("weight"))


def _cuts(cells: DataFrame, dims: int) -> DataFrame:
    """The cut of every cell of more than one shard: its axis and the step, text hash and row hash of the median."""
    lows, highs = ([F.col("x")[i] for i in range(dims + 1)] for _ in range(2))
    open_cells = cells.where("k > 1")
    sums = open_cells.groupBy("lo", "k").agg(
        F.sum("size").alias("total"), F.array(*[F.min(c) for c in lows]).alias("low"),
        F.array(*[F.max(c) for c in highs]).alias("high"))
    # Width is a share of the whole table's range; the widest axis, of equal ones the first.
    whole = cells.select(F.array(*[F.max(c) - F.min(c) for c in lows])).scalar()
    width = [F.when(F.col("range")[i] > 0, (F.col("high")[i] - F.col("low")[i]) / F.col("range")[i]).otherwise(0.0)
             for i in range(dims + 1)]
    axis = F.array_max(F.array(*[F.struct(w.alias("width"), F.lit(-i).alias("back"), F.lit(i).alias("axis"))
                                 for i, w in enumerate(width)])).axis
    plan = sums.withColumn("range", whole).withColumn("axis", axis).select(
        "lo", "k", "axis", F.element_at("low", F.col("axis") + 1).alias("low"),
        (F.element_at("high", F.col("axis") + 1) - F.element_at("low", F.col("axis") + 1)).alias("span"),
        (F.col("total") * F.floor(F.col("k") / 2) / F.col("k")).alias("goal"))
    plan = materialize(plan, "kd-plan")
    one = _crossing(_placed(open_cells, plan).groupBy("lo", "k", "goal", "s1").agg(F.sum("size").alias("size")), "s1")
    one = materialize(one.drop("weight"), "kd-cut")
    rows = _placed(open_cells, plan.drop("goal")).join(F.broadcast(one), ["lo", "k", "s1"])
    two = _crossing(rows.groupBy("lo", "k", "goal", "s2").agg(F.sum("size").alias("size")), "s2")
    two = materialize(two.drop("weight").join(one.drop("goal"), ["lo", "k"]), "kd-cut")
    rows = _placed(open_cells, plan.drop("goal")).join(F.broadcast(two), ["lo", "k", "s1", "s2"])
    three = _crossing(rows.groupBy("lo", "k", "goal", "s3").agg(F.sum("size").alias("size")), "s3")
    # The last step goes to the side to which it is nearer.
    three = three.withColumn("s3", F.col("s3") - F.when(F.col("goal") * 2 < F.col("weight"), 1).otherwise(0))
    ends = [F.col(c).alias(f"end{c[1]}") for c in ("s1", "s2", "s3")]
    return materialize(three.join(two.drop("goal"), ["lo", "k"]).select("lo", "k", *ends).join(
        plan.drop("goal"), ["lo", "k"]), "kd-cut")


def _placed(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of cells with their steps; there are fewer cells than shards, so their plan is broadcast."""
    share = F.when(F.col("span") > 0, (F.element_at("x", F.col("axis") + 1) - F.col("low")) / F.col("span")).otherwise(0.0)
    return cells.join(F.broadcast(plan), ["lo", "k"]).withColumns({
        "s1": F.floor(share * (_STEPS - 1)).cast("int"), "s2": _step(F.col("h")), "s3": _step(F.col("own"))})


def assign(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """Prepared rows with their shard."""
    cells = rows.withColumns({"lo": F.lit(0), "k": F.lit(shards)})
    largest = shards
    while largest > 1:
        cuts = _cuts(cells, dims)
        below = F.struct("s1", "s2", "s3") <= F.struct(F.col("end1").alias("s1"), F.col("end2").alias("s2"), F.col("end3").alias("s3"))
        half = F.floor(F.col("k") / 2).cast("int")
        split = _placed(cells.where("k > 1"), cuts).withColumn("left", below).withColumns({
            "lo": F.when(F.col("left"), F.col("lo")).otherwise(F.col("lo") + half),
            "k": F.when(F.col("left"), half).otherwise(F.col("k") - half)}).select(cells.columns)
        cells = split if largest == shards else split.union(cells.where("k = 1"))
        largest -= largest // 2
        if largest > 1:
            cells = materialize(cells, "kd-cells")
    return cells.withColumnRenamed("lo", "shard").drop("k")


def with_slots(assigned: DataFrame) -> DataFrame:
    """Adds slot: gapless places from 0 within each shard, by the number of the row.

    Rows count up within the task that wrote them, and tasks are added up, so no
    task gets all rows of a shard.
    """
    assigned = assigned.withColumn("part", F.shiftright("number", 33))
    counts = assigned.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("number"))
    return assigned.join(starts, ["shard", "part"]).withColumn("slot", F.col("start") + own - 1).drop("part", "start")


def shard_documents(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"),
                    id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, shards of near equal bytes.

    Size: bytes of the text in UTF-8 plus 1. Dimensions that the table lacks are
    left out; without any, rows are cut by the hash of their text. Nulls lie
    before all other values of an axis, a null text has no bytes, a null id is
    kept. Equal texts of equal metadata stay side by side and are parted only
    where a cut falls on them. A document is never cut, so shards differ by
    about the largest one. Repeated rows are rows of their own. Other columns
    are not read, or with `keep` returned in the struct `row`. An empty table
    gives no rows.
    """
    dimensions = [d for d in dimensions if d in docs.columns]
    rows = prepared(docs, dimensions, id_col, text_col, keep)
    assigned = materialize(assign(rows, len(dimensions), shards), "kd-shards")
    return with_slots(assigned).select("doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if keep else []))


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 1, **options) -> None:
    """All rows of docs in one folder per shard (`shard=0`; with `_` behind the name if docs has such a column)."""
    placed = shard_documents(docs, shards, keep=True, **options)
    folder = "shard"
    while folder.lower() in (c.lower() for c in docs.columns):
        folder += "_"
    placed.repartition(shards * files, "shard", F.pmod("slot", F.lit(files))).select(
        "row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The placement of every document under the law of equal bytes."""
    return shard_documents(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
