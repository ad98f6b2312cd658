"""Exact top-k by inner product, reading sorted lists without random access.

Vectors are kept in blocks. For a block and a query, every component has a list
of the block's values, best first for the query's sign. The lists are read from
the top in steps; what has been read of a vector bounds its score from below
and above. Reading stops when no more vectors than a few times k can still
reach the k-th lower bound; their scores are then resolved. The k-th best score
of the blocks before it serves as a bound for the next block.

The bounds of a step are sums over what was read, or else the last value read,
so all queries of a block get theirs in one product of matrices.

Every query block meets every block of candidates once: a task holds a few
blocks of candidates, a slot, while query blocks stream past. Query blocks are
copied to each slot, and a slot that many queries visit is copied. Neither is
broadcast, and no row holds a pair. Only local winners are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import giving_back
from shoplens.operators.numbering import numbered

_LONG = 2 ** 63
BLOCK_SCHEMA = "dims int, ids binary, cells binary"
HELD_BLOCKS = 4         # of candidates a task holds at a time
STREAM_QUERIES = 1 << 12    # that visit one copy of a slot
_PLACE = ["slot", "copy"]


def scaled(values: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) as integers; Python integers where 64 bits do not hold them."""
    cells = np.floor(values * float(scale))
    if len(cells) and np.abs(cells).max() >= 2.0 ** 62:
        return np.array([int(c) for c in cells.ravel()], object).reshape(cells.shape)
    return cells.astype(np.int64)


def blocks(vectors: DataFrame, values: int = 1 << 18, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Vectors of one length in blocks of about `values` components.

    Vectors that are null, empty or hold null or non-finite components take no
    part, and neither do rows without an id. Ids and components travel as 64-bit numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            ids, rows = waiting.pop(dims)
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([np.concatenate(rows).astype("<f8").tobytes()], pa.binary())],
                ["dims", "ids", "cells"])

        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = 0
            for vec_id, n in zip(batch.column(0).to_pylist(), pc.list_value_length(column).to_pylist()):
                row = flat[at:at + (n or 0)]
                at += n or 0
                if vec_id is None or not n or not np.isfinite(row).all():
                    continue
                ids, rows = waiting.setdefault(n, ([], []))
                ids.append(vec_id)
                rows.append(row)
                if len(ids) * n >= values:
                    yield flush(n)
        for dims in list(waiting):
            yield flush(dims)

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("embedding")).mapInArrow(
        run, BLOCK_SCHEMA)


class Lists:
    """The sorted lists of one block of candidates."""

    QUERIES = 256       # that are answered at a time

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids = ids
        self.largest = max(abs(int(cells.max())), abs(int(cells.min())))
        self.tables = {cells.dtype: (cells, np.sort(cells, axis=0))}
        self.kept = cells.dtype

    def _as(self, kind) -> tuple[np.ndarray, np.ndarray]:
        """The values by row and by place in the lists, as numbers of this kind."""
        kind = np.dtype(kind)
        if kind not in self.tables:
            self.tables[kind] = tuple(x.astype(kind) for x in self.tables[self.kept])
        return self.tables[kind]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: list[int | None],
             step: int = 64) -> list[list[tuple[int, int]]]:
        """(score, vec_id) of the k best of every query that can reach its `least`; ties to the smaller id.

        Reading ends when all but a sixteenth of the block (or 4 k) are ruled out.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in least]
        highs = [self.largest * max(1, int(m)) * queries.shape[1] for m in np.abs(queries).max(axis=1)]
        kinds: dict[type, list[int]] = {}
        for at, high in enumerate(highs):
            if least[at] is None or least[at] <= high:
                kinds.setdefault(np.float64 if high < 2 ** 53 else np.int64 if high < _LONG else object, []).append(at)
        for kind, those in kinds.items():
            for start in range(0, len(those), self.QUERIES):
                some = those[start:start + self.QUERIES]
                self._answer(found, some, query_ids[some], queries[some].astype(kind), k,
                             [least[at] for at in some], max(highs[at] for at in some), step)
        return found

    def _answer(self, found: list, places: list[int], query_ids: np.ndarray, queries: np.ndarray, k: int,
                least: list[int | None], high: int, step: int) -> None:
        """`best` of queries whose sums, up to `high`, are exact in the kind of number they have."""
        kind = queries.dtype
        cells, lists = self._as(kind)
        n = len(cells)
        signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])    # read from the top, and from the bottom
        bound = np.array([-high if x is None else max(x, -high) for x in least], kind)
        unknown = np.array([x is None for x in least])
        reading = np.arange(len(places))
        depth = 0
        while len(reading):
            depth = min(n, max(step, 4 * depth))
            top, bottom = lists[n - depth], lists[depth - 1]
            own = self.ids[None, :] == query_ids[reading][:, None]
            upper = signed[reading] @ np.hstack([np.maximum(cells, top), np.minimum(cells, bottom)]).T
            new = unknown[reading]
            if n >= k and new.any():
                lower = signed[reading[new]] @ np.hstack([np.where(cells >= top, cells, lists[0]),
                                                          np.where(cells <= bottom, cells, lists[-1])]).T
                lower[own[new]] = -high     # no score is lower
                bound[reading[new]] = np.maximum(bound[reading[new]], np.partition(lower, n - k, axis=1)[:, n - k])
            able = ~own & (upper >= bound[reading][:, None])
            done = (able.sum(axis=1) <= max(4 * k, n // 16)) | (depth == n)
            for row in np.flatnonzero(done):
                at, left = reading[row], np.flatnonzero(able[row])
                # The outsiders are out: resolve the rest, unless everything has been read.
                scores = upper[row, left] if depth == n else cells[left] @ queries[at]
                found[places[at]] = self._first(scores, self.ids[left], k)
            reading = reading[~done]

    @staticmethod
    def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        if scores.dtype != object:
            order = np.lexsort((ids, -scores))[:k]
            return [(int(s), i) for s, i in zip(scores[order], ids[order].tolist())]
        return [(-s, i) for s, i in sorted(zip((-int(s) for s in scores), ids.tolist()))[:k]]


def _stream(k: int, scale: int):
    """Rows come sorted by place, blocks of candidates of a place before those of queries."""
    def winners(query_ids: np.ndarray, rows: np.ndarray, held: list[Lists]) -> pa.RecordBatch:
        best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        for lists in held:
            least = [x[-1][0] if len(x) == k else None for x in best]
            for at, found in enumerate(lists.best(query_ids, rows, k, least)):
                if found:
                    best[at] = sorted(best[at] + found, key=lambda x: (-x[0], x[1]))[:k]
        flat = [(q, i, max(-_LONG, min(_LONG - 1, s))) for q, x in zip(query_ids.tolist(), best) for s, i in x]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in flat], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                *place, kind, dims, ids, cells = (
                    batch.column(c)[row].as_py() for c in [*_PLACE, "kind", "dims", "ids", "cells"])
                if place != now:
                    now, held = place, {}
                ids = np.frombuffer(ids, "<i8")
                rows = scaled(np.frombuffer(cells, "<f8").reshape(-1, dims), scale)
                if not kind:
                    held.setdefault(dims, []).append(Lists(ids, rows))
                elif dims in held:
                    yield winners(ids, rows, held[dims])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
           id_col: str = "vec_id", vector_col: str = "embedding", values: int = 1 << 18,
           stream: int = STREAM_QUERIES) -> DataFrame:
    """The k best other vectors of every query: query_id, rank, vec_id, score.

    Score: inner product of floor(scale * component), exact. Only vectors of a
    query's own length are compared with it; a query is not its own candidate;
    fewer than k candidates give fewer rows. A score outside 64 bits is shown
    as the nearest 64-bit number. Repeated rows are candidates of their own.

    A block has about `values` components; about `stream` queries visit a copy of a slot.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    candidates, made = numbered(blocks(vectors, values, id_col, vector_col), "block", "blocks")
    asked, asking = numbered(blocks(queries, max(1, values // 8), id_col, vector_col), "block", "queries")
    n = asked.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    # A small table is spread over the cores; a larger one has more slots anyway.
    each = max(1, min(HELD_BLOCKS, -(-made // cores)))
    slots = max(1, -(-made // each))
    copies = max(1, min(asking, max(-(-int(n) // stream), -(-cores // slots))))
    place = F.floor(F.col("block") / each).cast("int").alias("slot")
    kept = candidates.select(place, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
                             F.lit(0).alias("kind"), "dims", "ids", "cells")
    # A row per slot and length of vectors.
    places = F.broadcast(candidates.select("dims", place).distinct())
    sent = asked.join(places, "dims").select("slot", (F.col("block") % copies).cast("int").alias("copy"),
                                             F.lit(1).alias("kind"), "dims", "ids", "cells")
    dealt = kept.union(sent).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "kind")
    found = dealt.mapInArrow(giving_back(_stream(k, scale)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
