"""Packing documents into sequences: fill greedily, then trade the smallest for two.

Best-two-fit looks at lengths only, so it runs on the counts of the lengths
(at most one per length up to the capacity, whatever the corpus size): take the
longest length left, fill its sequence with the longest that still fits, then
replace the smallest one with the two unpacked lengths that fill the widened
gap best, if they fill it more tightly. The resulting pattern is used as often
as the counts allow, which is what repeating the step one by one would give.

Pieces get their pattern by their rank among the pieces of their length. Ranks
come from counters of the writing tasks and the sums of earlier tasks, so a
length that a third of all pieces have needs no task of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm import library
from shoplens.llm.common import give_back, giving_back, id_and_text, portions_of
from shoplens.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long")


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids plus `end_id` of every whole text, cut only where longer than the capacity.

    Of a cut document all pieces but the first are full. `place` numbers the
    pieces of a length inside the writing task. A null text is an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library.encoder(vocabulary)
        task = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, stop in portions_of(pc.binary_length(batch.column(1)).to_pylist(), 4_000_000):
                give_back()
                some = batch.slice(first, stop - first)
                ids, at = encode.encode_texts(some.column(1).to_pylist())
                raw = ids.astype("<u4").tobytes()
                rows: list[tuple] = []
                for doc_id, a, b in zip(some.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    data = raw[4 * a:4 * b] + end
                    size = b - a + 1
                    cuts = [0, *range(size % capacity or capacity, size + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc_id, k, x, y - x, zlib.crc32(data[4 * x:4 * y]), task,
                                     int(used[y - x])))
                        used[y - x] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                         pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    [c.split()[0] for c in PIECES.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(giving_back(run), PIECES)


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit on counts by length: (lengths of a sequence, how many such sequences)."""
    left = np.array(counts, np.int64)
    left[0] = 0
    out = []

    def longest(limit: int) -> int:
        fits = np.flatnonzero(left[:limit + 1])
        return int(fits[-1]) if len(fits) else 0

    while left.any():
        before = left.copy()
        content: list[int] = []
        gap = capacity
        while gap and (length := longest(gap)):
            content.append(length)
            left[length] -= 1
            gap -= length
        if gap and len(content) > 1:
            smallest = content[-1]
            room, best = gap + smallest, (smallest, 0, 0)
            for x in np.flatnonzero(left[:room])[::-1].tolist():
                if 2 * x <= best[0]:
                    break
                left[x] -= 1
                y = longest(min(room - x, x))
                left[x] += 1
                if y and x + y > best[0]:
                    best = (x + y, x, y)
                    if x + y == room:
                        break
            if best[1]:
                content[-1:] = best[1:]
        need = np.bincount(content, minlength=len(before))
        used = need > 0
        times = int((before[used] // need[used]).min())
        left = before - times * need
        out.append((content, times))
    return out


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """A sequence and a place in it for every piece of a materialized table of pieces."""
    counts = np.zeros(capacity + 1, np.int64)
    per_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]  # at most one row per length
    # For each length, in order of rank: from which rank on a slot of a pattern serves it.
    taken = np.zeros(capacity + 1, np.int64)
    keys, first_ranks, sequences, places = [], [], [], []
    sequence = 0
    for content, times in patterns(counts, capacity):
        at = 0
        for length in content:
            keys.append(length << 44 | int(taken[length]))
            first_ranks.append(int(taken[length]))
            sequences.append(sequence)
            places.append(at)
            taken[length] += times
            at += length
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    keys, first_ranks, sequences, places = (
        np.array(x, np.int64)[order] for x in (keys, first_ranks, sequences, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "rank"))
            slot = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(sequences[slot] + rank - first_ranks[slot]), pa.array(places[slot])],
                [c.split()[0] for c in PACKED.split(", ")])

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1))
    base = per_task.select("task", "length", F.coalesce(earlier, F.lit(0)).alias("base"))
    return cut.join(base, ["task", "length"]).withColumn(
        "rank", F.col("place") + F.col("base")).drop("task", "place", "base").mapInArrow(giving_back(run), PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its gapless place there.

    The pieces are written to the shared folder once, because their numbers
    must stay as they are while the lengths are counted. Repeated rows are
    packed like any others; an empty table gives no rows.
    """
    cut = pieces(docs, vocabulary, end_id, capacity, id_col, text_col)
    return pack(materialize(cut, "pieces"), capacity)
