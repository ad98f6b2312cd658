"""Small helpers the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def worker_cache(owner: str) -> dict:
    """A dictionary of one operator that lives on in this Python process.

    Python workers are reused from task to task; loaded vocabularies and the
    bounded word caches stay in them. Everything in it can be rebuilt, and what
    another operator left is dropped, so that a worker holds those of one.
    """
    name = "_shoplens_worker_cache"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    held = module.__dict__.setdefault("entries", {})
    if set(held) - {owner}:
        held.clear()
        gc.collect()
        give_back()
    return held.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory of this Python process to the system; idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches, after which the worker, idle from then on, holds no freed memory."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def portions_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about `most`; a larger item is a range of its own."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, a null text as the empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def in_one_column(docs: DataFrame) -> DataFrame:
    """Whole rows as the struct `row`, so that columns added beside it clash with none of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; documents of fold 2 are held out of all training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[start:start+len], one after the other."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lens)
    return flat[np.arange(total) + np.repeat(starts - (ends - lens), lens)]


def offsets(lens) -> np.ndarray:
    """0 and the running sums of the lengths."""
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
