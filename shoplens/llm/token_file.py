"""Token ids in files of directly addressable codes.

A segment holds the ids of consecutive documents. An id is split into bytes,
lowest first. Level k keeps the k-th byte of every id that has one, a bitmap
beside it says which of them continue on level k+1, and a directory counts the
set bits before every block of 512. Token i is read from level 0 at place i;
while its bit is set, its place on the next level is the number of set bits
before it. No other token is decoded for that.

The file is a folder: `segments` (Parquet rows, one segment each, ascending by
part and segment) and `parts` (the first token number of every part). Spark's
commit protocol writes both, so a lost executor leaves no half file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import library
from shoplens.llm.chunks import portions
from shoplens.llm.common import id_and_text, offsets

BLOCK = 512
_SEGMENT = pa.schema([
    ("part", pa.int32()), ("segment", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
    ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())),
    ("ranks", pa.list_(pa.binary()))])
SEGMENT_SCHEMA = ("part int, segment long, first long, n_tokens long, doc_ids array<long>, "
                  "doc_starts array<long>, levels array<binary>, bitmaps array<binary>, "
                  "ranks array<binary>")


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of the ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >= 256
        levels.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(
            more) else np.zeros(0, np.uint32)
        ranks.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
        rest = rest[more] >> np.uint32(8)
    return levels, bitmaps, ranks


class Codes:
    """Reader of one segment's codes."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    def at(self, places) -> np.ndarray:
        """Ids at any places, in the order asked for."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.int64)
        who = np.arange(len(places))
        for k, level in enumerate(self.levels):
            if not len(places):
                break
            out[who] |= level[places].astype(np.int64) << (8 * k)
            bits = self.bitmaps[k]
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            places, who = places[on], who[on]
            block = places // BLOCK
            first = block * (BLOCK // 8)
            upto = np.zeros(len(places), np.int64)  # set bits of the block before the place
            for step in range(BLOCK // 8):
                byte = first + step
                full = byte < places >> 3
                part = byte == places >> 3
                if not (full | part).any():
                    break
                value = bits[np.minimum(byte, len(bits) - 1)]
                value = np.where(part, value & ((1 << (places & 7)) - 1).astype(np.uint8), value)
                upto += np.where(full | part, np.bitwise_count(value), 0)
            places = self.ranks[k][block].astype(np.int64) + upto
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level from the last."""
        rest = np.zeros(0, np.uint32)
        for level, bits in zip(reversed(self.levels), reversed(self.bitmaps)):
            out = level.astype(np.uint32)
            more = np.unpackbits(bits, count=len(level), bitorder="little").astype(bool)
            out[more] |= rest << np.uint32(8)
            rest = out
        return rest


def write(docs: DataFrame, path: str, vocabulary: str, word_ends: bool = True, end_id: int = 1,
          id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1 << 20) -> None:
    """Encode every whole text, append `end_id`, and write all ids by ascending id column.

    Rows of one id keep an order by their text's hash; a null id comes first, a
    null text is an empty one. Documents are dealt out by ranges of (id, hash),
    so no single id fills a task. A segment ends with the document that fills it.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library.encoder(vocabulary, word_ends)
        part = TaskContext.get().partitionId()
        segment = first = size = 0
        names: list = []
        starts: list[int] = []
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            levels, bitmaps, ranks = pack(np.concatenate(waiting))
            return pa.RecordBatch.from_pylist([{
                "part": part, "segment": segment, "first": first, "n_tokens": size,
                "doc_ids": names, "doc_starts": starts, "levels": levels, "bitmaps": bitmaps,
                "ranks": ranks}], _SEGMENT)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in portions(texts, 4_000_000):
                ids, at = encode.encode_texts(texts[start:stop])
                for i, doc_id in enumerate(doc_ids[start:stop]):
                    names.append(doc_id)
                    starts.append(size)
                    waiting += [ids[at[i]:at[i + 1]], np.array([end_id], np.int32)]
                    size += int(at[i + 1] - at[i]) + 1
                    if size >= segment_tokens:
                        yield flush()
                        segment, first, size = segment + 1, first + size, 0
                        names, starts, waiting = [], [], []
        if names:
            yield flush()

    ordered = (id_and_text(docs, id_col, text_col)
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(F.col("doc_id"), F.col("tie"))
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(
        f"{path}/segments")
    sizes = {r.part: r.n for r in spark.read.parquet(f"{path}/segments").groupBy("part").agg(
        F.sum("n_tokens").alias("n")).collect()}  # one row per task of the write
    base, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, base))
        base += sizes[part]
    spark.createDataFrame(rows, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    # one small row per task of the write
    return spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments").join(
        F.broadcast(parts), "part")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes(row["levels"], row["bitmaps"], row["ranks"]).all()
                if len(ids) != row["n_tokens"]:
                    raise ValueError("a segment does not hold the ids it names")
                at = np.append(np.array(row["doc_starts"], np.int64), len(ids))
                raw = ids.astype("<u4").tobytes()
                columns = [pa.array(row["doc_ids"], pa.int64()),
                           pa.array(row["base"] + row["first"] + at[:-1]), pa.array(np.diff(at)),
                           pa.array([zlib.crc32(raw[4 * a:4 * b])
                                     for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                                    pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _segments(spark, path).select(
        "base", "first", "n_tokens", "doc_ids", "doc_starts", "levels", "bitmaps", "ranks"
    ).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """(place, token_id) for a list of token numbers, each read directly from its segment."""
    wanted = np.unique(np.array(places, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = row["base"] + row["first"]
                mine = wanted[(wanted >= low) & (wanted < low + row["n_tokens"])]
                ids = Codes(row["levels"], row["bitmaps"], row["ranks"]).at(mine - low)
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(ids)],
                                                 ["place", "token_id"])

    low = F.col("base") + F.col("first")
    hit = F.exists(F.lit(wanted.tolist()), lambda p: (low <= p) & (low + F.col("n_tokens") > p))
    return _segments(spark, path).where(hit).select(
        "base", "first", "n_tokens", "levels", "bitmaps", "ranks").mapInArrow(
            run, "place long, token_id long")
