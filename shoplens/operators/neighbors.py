"""Cosine nearest neighbours: exact with metric pruning, inside groups, and by hashing.

Rows of an index are `(key, vector)`, rows of a query set `(query_id, vector)`.
Scores are cosines rounded to six digits, higher is closer, ties go to the
smaller key. Rows whose vector is null, of another length, or holds null or
non-finite components take no part.

All three searches send index rows and queries to buckets. A bucket is cut into
slots of bounded bytes; each query visits every slot of its buckets, and a
bucket that very many queries visit is copied. A task holds one slot, and the
queries stream past it; only its best k per query leave the task. The search by
hashing holds the queries and lets the index rows stream past.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shoplens.operators.dedup import first_n
from shoplens.session import materialize

SLOT_BYTES = 4 << 20            # of index vectors a task holds at a time, in doubles
FEW_SLOTS = 128                 # smaller slots grow until an index has so few, or they have SLOT_BYTES
STREAM_ROWS = 1 << 14           # queries that visit one copy of a slot
BATCH_ROWS = 1 << 14            # visits of queries that leave a task at a time
PLAN_CELLS = 1 << 20            # of a batch of queries by rings
PIVOTS = 256
RINGS = 64
SAMPLE_ROWS = 16                # looked at for each pivot
FLIPS = 12                      # signs of a bucket number that probing one by one may change
ASKED_BYTES = 16 << 20          # of query vectors a task of the search by hashing holds, in doubles
PASSING_ROWS = 1 << 17          # index rows that pass them in one task
PREFIX = 12                     # signs of a bucket number that tell its group, at most
VISIT_PAIRS = 2000              # compared in the time that moving a query to one more place takes
HITS = "query_id string, key string, score double"
_PLACE = ["bucket", "slot", "copy"]


# --- vectors in batches -----------------------------------------------------

def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """The rows of a list column, all of one length; null components become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dimensions)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def _units(df: DataFrame, name: str, dimensions: int, schema: str,
           per_batch: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], *extra: str,
           at_once: int = 1 << 30) -> DataFrame:
    """`per_batch(rows, unit vectors)` on the searchable rows `(name, vector, *extra)`, `at_once` of them at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                rows = _matrix(batch.column("vector"), dimensions)
                finite = np.isfinite(rows).all(axis=1)
                if finite.any():
                    yield from per_batch(batch.filter(pa.array(finite)), unit_rows(rows[finite]))

    return (df.filter(F.size("vector") == dimensions)
            .select(F.col(name).cast("string").alias(name), F.col("vector").cast("array<float>").alias("vector"), *extra)
            .mapInArrow(run, schema))


def _with(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, pa.array(values))
    return batch


def _repeated(batch: pa.RecordBatch, rows: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by number, with new columns, BATCH_ROWS at a time: a query may visit very many places."""
    for at in range(0, len(rows), BATCH_ROWS):
        some = slice(at, at + BATCH_ROWS)
        yield _with(batch.take(pa.array(rows[some])), **{name: values[some] for name, values in columns.items()})


# --- what a task does -------------------------------------------------------

class Best:
    """Running best k keys per query."""

    QUERIES, ROWS = 1024, 4096      # slice of the score matrix held at a time

    def __init__(self, ids, k: int, least=None):
        self.ids, self.k = ids, k
        self.least = np.full(len(ids), -np.inf) if least is None else np.array(least, "float64")
        self.held: list[list[tuple[float, str]]] = [[] for _ in ids]

    def add(self, queries: np.ndarray, keys: np.ndarray, rows: np.ndarray, only: np.ndarray) -> None:
        """Scores of the queries numbered `only` against rows."""
        for q in range(0, len(only), self.QUERIES):
            some = only[q:q + self.QUERIES]
            for r in range(0, len(keys), self.ROWS):
                self._slice(some, queries[some] @ rows[r:r + self.ROWS].T, keys[r:r + self.ROWS])

    def _slice(self, some: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        cut = self.least[some]
        if self.k < len(keys) and np.isinf(cut).any():
            cut = np.maximum(cut, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        # Order is by rounded score, then key: keep all that may round up to the cut.
        cut = cut - 1e-6
        for i in np.flatnonzero(scores.max(axis=1) >= cut):
            near = np.flatnonzero(scores[i] >= cut[i])
            values = np.round(scores[i][near], 6) + 0.0
            held = sorted(self.held[some[i]] + list(zip((-values).tolist(), keys[near])))[:self.k]
            self.held[some[i]] = held
            if len(held) == self.k:
                self.least[some[i]] = max(self.least[some[i]], -held[-1][0])

    def rows(self) -> pa.RecordBatch:
        flat = [(self.ids[i], key, -s + 0.0) for i, held in enumerate(self.held) for s, key in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.string()),
             pa.array([r[2] for r in flat], pa.float64())], ["query_id", "key", "score"])


def reach(score: np.ndarray) -> np.ndarray:
    """The distance of unit vectors at a score, with room for rounding."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (score - 2e-6))) + 1e-7


class Slot:
    """Some index rows of one bucket, ordered by their distance to the bucket's pivot."""

    ROWS = 512

    def __init__(self, keys: np.ndarray, rows: np.ndarray, near: np.ndarray):
        order = np.argsort(near, kind="stable")
        self.keys, self.rows, self.near = keys[order], rows[order], near[order]
        self.skipped = self.scored = 0

    def search(self, ids, queries: np.ndarray, near: np.ndarray, least: np.ndarray, k: int) -> pa.RecordBatch:
        """Best k per query. Blocks farther from the pivot, or nearer, than a query's
        distance to it by more than the reach of its k-th score are skipped."""
        best = Best(ids, k, least)
        starts = np.arange(0, len(self.keys), self.ROWS)
        away = np.abs(self.near[starts] - (near.mean() if len(near) else 0.0))
        for at in starts[np.argsort(away, kind="stable")]:
            block = slice(at, at + self.ROWS)
            low, high = self.near[block][0], self.near[block][-1]
            far = reach(best.least)
            only = np.flatnonzero((near - high <= far) & (low - near <= far))
            size = len(self.keys[block])
            self.scored += size * len(only)
            self.skipped += size * (len(near) - len(only))
            if len(only):
                best.add(queries, self.keys[block], self.rows[block], only)
        return best.rows()


def _runs(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple]:
    """Stretches of rows of one place and kind: place, kind, names, ids, unit vectors, near, least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        differs = np.zeros(n, bool)
        for name in [*_PLACE, "kind"]:
            column = batch.column(name)
            differs[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(differs).tolist(), n]
        units = unit_rows(_matrix(batch.column("vector"), dimensions))
        near, least = (batch.column(c).to_numpy() for c in ("near", "least"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for a, b in zip(cuts, cuts[1:]):
            place = tuple(batch.column(c)[a].as_py() for c in _PLACE)
            yield (place, batch.column("kind")[a].as_py(), batch.column("id").slice(a, b - a), ids[a:b], units[a:b],
                   near[a:b], least[a:b])


def _stream(dimensions: int, k: int) -> Callable:
    """Rows come sorted by place, index rows of a place before its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, slot = None, [], None
        for place, kind, _, ids, units, near, least in _runs(batches, dimensions):
            if place != now:
                now, parts, slot = place, [], None
            if not kind:
                parts.append((ids, units, near))
            elif parts:
                slot = slot or Slot(*(np.concatenate(x) for x in zip(*parts)))
                yield slot.search(ids, units, near, least, k)

    return run


def _slot_rows(slot_bytes: int, dimensions: int, n: int = 0) -> int:
    """Rows of a slot in an index of `n` rows: a query carries its vector to every slot it visits."""
    most = max(slot_bytes, SLOT_BYTES) // (8 * dimensions)
    return max(1, slot_bytes // (8 * dimensions), min(most, n // FEW_SLOTS))


def _number(rows: int, name: str) -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(rows)), F.lit(1)).cast("int").alias(name)


def _sizes(index: DataFrame, queries: DataFrame, dimensions: int, slot_bytes: int) -> DataFrame:
    """Slots and copies of every bucket that has both rows and queries."""
    return index.groupBy("bucket").agg(_number(_slot_rows(slot_bytes, dimensions), "slots")).join(
        queries.groupBy("bucket").agg(_number(STREAM_ROWS, "copies")), "bucket")


def _dealt(index: DataFrame, queries: DataFrame, sizes: DataFrame, held: str = "index") -> DataFrame:
    """Index rows and queries side by side in their places, those that a task holds (kind 0) first.

    index: (bucket, key, vector, near), queries: (bucket, query_id, vector, near,
    least), sizes: (bucket, slots, copies). Rows that pass held queries do so in the order of their keys.
    """

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one_of(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    first = held == "index"
    left = index.join(sizes, "bucket").select(
        "bucket", one_of("key", "slots").alias("slot"), every("copies").alias("copy"), F.lit(int(not first)).alias("kind"),
        F.col("key").alias("id"), "vector", "near", F.lit(0.0).alias("least"))
    right = queries.join(sizes, "bucket").select(
        "bucket", every("slots").alias("slot"), one_of("query_id", "copies").alias("copy"), F.lit(int(first)).alias("kind"),
        F.col("query_id").alias("id"), "vector", "near", "least")
    return left.union(right).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "kind", *([] if first else ["id"]))


def _visited(index: DataFrame, queries: DataFrame, k: int, dimensions: int, sizes: DataFrame) -> DataFrame:
    """Best k of each query per slot of its buckets, as HITS."""
    return _dealt(index, queries, sizes).mapInArrow(_stream(dimensions, k), HITS)


def _merge(hits: DataFrame, k: int) -> DataFrame:
    """Best k of the slots' winners."""
    return first_n(hits, ["query_id"], [F.desc("score"), F.asc("key")], k, rank="rank")


# --- exact search -----------------------------------------------------------

class Rings:
    """The pivots, and of each pivot's rings the number of rows and the nearest and farthest one."""

    def __init__(self, pivots: np.ndarray, rings: list[tuple[int, int, int, float, float]]):
        self.pivots, self.zero = pivots, ~pivots.any(axis=1)
        self.pivot, self.ring, self.n = (np.array([r[i] for r in rings], np.int64) for i in range(3))
        self.low, self.high = (np.array([r[i] for r in rings], np.float64) for i in (3, 4))

    def distances(self, units: np.ndarray, index: bool) -> np.ndarray:
        """Distances to the pivots. Vectors of zeros are at right angles to all others,
        those of the index all the same one, those of queries another."""
        inner = units @ self.pivots.T
        if index:
            inner = inner + (~units.any(axis=1))[:, None] * self.zero[None, :]
        return np.sqrt(np.maximum(0.0, 2 - 2 * np.minimum(inner, 1.0)))

    def bounds(self, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest distance that a query may have to the rows of each ring."""
        d = away[:, self.pivot]
        return np.maximum(0.0, np.maximum(d - self.high, self.low - d)) - 1e-7, d + self.high

    def first(self, away: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The rings that surely hold k rows within the smallest reach, and that reach."""
        _, most = self.bounds(away)
        order = np.argsort(most, axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1)
        needed = held - self.n[order] < k
        last = needed.sum(axis=1) - 1
        chosen = np.zeros_like(needed)
        np.put_along_axis(chosen, order, needed, axis=1)
        far = np.take_along_axis(most, np.take_along_axis(order, last[:, None], 1), 1)[:, 0]
        return chosen, np.where(held[:, -1] >= k, far, np.inf)


def _sample(df: DataFrame, name: str, n: int, dimensions: int, rows: int) -> np.ndarray:
    """The unit vectors of at most `n` of the `rows`, chosen by a hash of their key; of few if very few are searchable."""
    def chosen(some: DataFrame) -> list:
        keep = _units(some, name, dimensions, "id string, vector array<float>", lambda batch, _: iter([batch.rename_columns(["id", "vector"])]))
        return keep.orderBy(F.xxhash64("id"), "id").limit(n).collect()

    share = F.pmod(F.xxhash64(F.lit(SAMPLE_ROWS), F.col(name)), F.lit(max(1, rows // (SAMPLE_ROWS * n))))
    found = chosen(df.filter(share == 0)) or chosen(df)
    return unit_rows(np.array([r.vector for r in found], "float64").reshape(-1, dimensions))


def _placed(index: DataFrame, pivots: np.ndarray, dimensions: int) -> DataFrame:
    """Index rows with their nearest pivot and the distance to it."""
    centres = Rings(pivots, [])

    def place(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        away = centres.distances(units, True)
        own = away.argmin(axis=1)
        yield _with(batch, pivot=own, near=away[np.arange(len(own)), own])

    return _units(index, "key", dimensions, "key string, vector array<float>, pivot long, near double", place)


def ring_index(index: DataFrame, dimensions: int, slot_bytes: int = SLOT_BYTES,
               pivots: int = PIVOTS) -> tuple[DataFrame, Rings]:
    """The index dealt to pivots and rings of about a slot's size, and their summary.

    Pivots are rows of the index, as many as it has slots, at most `pivots`. The
    summary has at most `pivots` x RINGS rows; only it and the pivots reach the driver.
    """
    n = index.count()
    slot_rows = _slot_rows(slot_bytes, dimensions, n)
    centres = _sample(index, "key", min(pivots, max(1, -(-n // slot_rows))), dimensions, n)
    placed = materialize(_placed(index, centres, dimensions), "placed")
    shares = [i / RINGS for i in range(1, RINGS)] if n > slot_rows else [0.5]   # else no pivot has several rings
    parts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("low"), F.max("near").alias("high"),
                                        F.percentile_approx("near", shares, 1000).alias("shares")).collect()
    edges = {}
    for p in parts:
        rings = min(RINGS, -(-p.n // slot_rows))
        edges[p.pivot] = sorted({p.shares[i * RINGS // rings - 1] for i in range(1, rings)})
    if not any(edges.values()):
        rows = placed.withColumn("bucket", F.col("pivot") * RINGS)
        return rows, Rings(centres, [(p.pivot, 0, p.n, p.low, p.high) for p in parts])
    table = index.sparkSession.createDataFrame(list(edges.items()), "pivot long, edges array<double>")
    ring = F.size(F.filter("edges", lambda e: e < F.col("near"))).cast("long")
    rows = placed.join(F.broadcast(table), "pivot").withColumn("bucket", F.col("pivot") * RINGS + ring).drop("edges")
    summary = rows.groupBy("bucket").agg(F.count(F.lit(1)), F.min("near"), F.max("near")).collect()
    return rows, Rings(centres, [(b // RINGS, b % RINGS, n, low, high) for b, n, low, high in summary])


def visits(queries: DataFrame, rings: Rings, k: int, dimensions: int, again: bool) -> DataFrame:
    """The rings each query has to visit: `(query_id, vector, bucket, near, least)`.

    First those that surely hold k rows. With `again`, queries carry the score of
    their k-th best row so far as `least`, and visit all others within its reach.
    """
    def plan(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        away = rings.distances(units, False)
        chosen, far = rings.first(away, k)
        least = 1 - far * far / 2 - 1e-6
        if again:
            least = batch.column("least").to_numpy(zero_copy_only=False)
            batch = batch.drop_columns(["least"])
            chosen = ~chosen & (rings.bounds(away)[0] <= reach(least)[:, None])
        query, ring = np.nonzero(chosen)
        yield from _repeated(batch, query, bucket=rings.pivot[ring] * RINGS + rings.ring[ring],
                             near=away[query, rings.pivot[ring]], least=least[query])

    return _units(queries, "query_id", dimensions, "query_id string, vector array<float>, bucket long, near double, "
                  "least double", plan, *(["least"] if again else []),
                  at_once=max(1, PLAN_CELLS // max(len(rings.n), len(rings.pivots))))


def knn_join(index: DataFrame, queries: DataFrame, k: int, dimensions: int,
             slot_bytes: int = SLOT_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """Exact `(query_id, key, score, rank)` of the k nearest keys of each query.

    Index rows lie in rings around pivots. A query first visits the rings that
    surely hold k rows; the score of its k-th best row then rules out, by the
    triangle inequality, all rings and blocks that are too far away. After Lu et
    al.: Efficient Processing of k Nearest Neighbor Joins using MapReduce (VLDB
    2012). Vectors without any structure rule out nothing and are all compared.
    """
    placed, rings = ring_index(index, dimensions, slot_bytes, pivots)
    if not len(rings.n):
        return index.sparkSession.createDataFrame([], HITS + ", rank int")

    # A small index is spread over the cores; a larger one has more slots anyway.
    n = int(rings.n.sum())
    spread = -(-n // index.sparkSession.sparkContext.defaultParallelism)
    rows = min(_slot_rows(slot_bytes, dimensions, n), max(512, spread))

    def hits(asked: DataFrame) -> DataFrame:
        # A row per ring; index rows of rings that no query visits are not moved.
        sizes = asked.sparkSession.createDataFrame(
            [(int(p * RINGS + r), max(1, -(-int(n) // rows))) for p, r, n in zip(rings.pivot, rings.ring, rings.n)],
            "bucket long, slots int").join(asked.groupBy("bucket").agg(_number(STREAM_ROWS, "copies")), "bucket")
        return _merge(_visited(placed.select("bucket", "key", "vector", "near"), asked, k, dimensions,
                               F.broadcast(sizes)), k)

    if len(rings.n) < 2:
        return hits(visits(queries, rings, k, dimensions, False))
    found = materialize(hits(visits(queries, rings, k, dimensions, False)), "first-hits")
    reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-2.0).alias("least"))
    asked = queries.withColumn("query_id", F.col("query_id").cast("string")).join(reached, "query_id")
    return _merge(found.drop("rank").union(hits(visits(asked, rings, k, dimensions, True)).drop("rank")), k)


def grouped_knn(index: DataFrame, queries: DataFrame, k: int, dimensions: int,
                slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """Exact k nearest among the rows with the query's own `bucket`."""
    left = _units(index, "key", dimensions, "key string, vector array<float>, bucket string", lambda batch, _: iter([batch]), "bucket")
    right = _units(queries, "query_id", dimensions, "query_id string, vector array<float>, bucket string",
                   lambda batch, _: iter([batch]), "bucket")
    nothing = F.lit(0.0).alias("near")
    return _merge(_visited(left.select("bucket", "key", "vector", nothing),
                           right.select("bucket", "query_id", "vector", nothing, F.lit(float("-inf")).alias("least")),
                           k, dimensions, _sizes(left, right, dimensions, slot_bytes)), k)


# --- search by hashing ------------------------------------------------------

def lsh_planes(bits: int, dimensions: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((24, dimensions))[:bits]


def lsh_bits(rows: int, bucket_rows: int = 8) -> int:
    """So many signs that a bucket would hold about `bucket_rows` evenly spread rows."""
    return int(np.clip(np.floor(np.log2(max(rows, 1) / bucket_rows)), 1, 24))


class Probes:
    """Bucket numbers by the signs of a vector on random planes (Charikar, 2002).

    A query probes buckets in the order of the squared margins of the signs that
    differ (Lv et al., 2007), over its FLIPS least certain signs.
    """

    def __init__(self, planes: np.ndarray):
        self.planes, self.bits = planes, len(planes)
        self.flips = min(FLIPS, self.bits)
        self.patterns = (np.arange(1 << self.flips)[:, None] >> np.arange(self.flips)) & 1

    def margins(self, units: np.ndarray) -> np.ndarray:
        return units @ self.planes.T

    def codes(self, margins: np.ndarray) -> np.ndarray:
        return (margins >= 0) @ (1 << np.arange(self.bits))

    def _costs(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of every pattern of flips of each row, and what it does to the bucket number."""
        weak = np.argsort(np.abs(margins), axis=1)[:, :self.flips]
        costs = np.take_along_axis(margins, weak, 1) ** 2 @ self.patterns.T
        return costs, (1 << weak) @ self.patterns.T

    def buckets(self, margins: np.ndarray, probes: int) -> np.ndarray:
        """The first `probes` buckets of each row."""
        costs, change = self._costs(margins)
        probes = min(probes, costs.shape[1])
        first = np.argpartition(costs, probes - 1, axis=1)[:, :probes]
        return self.codes(margins)[:, None] ^ np.take_along_axis(change, first, 1)

    def ranks(self, margins: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How many buckets each row probes before that of `codes`; a bucket that is never probed counts as 2**FLIPS."""
        costs, change = self._costs(margins)
        wanted = (self.codes(margins) ^ codes)[:, None] == change
        own = np.where(wanted, costs, np.inf).min(axis=1)
        return np.where(np.isfinite(own), (costs < own[:, None]).sum(axis=1), 1 << FLIPS)


    def _halves(self, margins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each row, the costs of all flips of the first half of the signs and of the others, both in order.

        The cost of any of the 2**bits patterns is a sum of one and one.
        """
        half = self.bits // 2
        first, rest = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1 for n in (half, self.bits - half))
        for row in margins ** 2:
            yield np.sort(first @ row[:half]), np.sort(rest @ row[half:])

    def below(self, margins: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How many of all buckets are cheaper to probe than that of `codes`, for each row."""
        own = (self.flipped(margins, codes) * margins ** 2).sum(axis=1)
        return np.array([np.searchsorted(b, cost * (1 - 1e-12) - 1e-300 - a, "right").sum()
                         for cost, (a, b) in zip(own, self._halves(margins))], np.int64)

    def flipped(self, margins: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The signs in which a row's own bucket and that of `codes` differ, as 0 and 1."""
        return ((self.codes(margins) ^ codes)[:, None] >> np.arange(self.bits)) & 1

    def limits(self, margins: np.ndarray, probes: int) -> np.ndarray:
        """For each row a cost that its `probes` cheapest buckets, of all, do not exceed, and no others but equal ones."""
        if probes >= 1 << self.bits:
            return np.full(len(margins), np.inf)
        out = np.empty(len(margins))
        for i, (a, b) in enumerate(self._halves(margins)):
            low, high, under, over = -1e-300, float(a[-1] + b[-1]), 0, 1 << self.bits
            turn = 0
            while over != probes:       # `under` < probes <= `over` buckets cost no more than `low` and `high`
                share = 0.5 if turn % 3 == 2 else (probes + 0.5 - under) / (over + 1 - under)
                turn += 1
                middle = low + share * (high - low)
                if not low < middle < high:
                    break
                n = int(np.searchsorted(b, middle - a, "right").sum())
                if n < probes:
                    low, under = middle, n
                else:
                    high, over = middle, n
            out[i] = high
        return out + 1e-12 * (margins ** 2).sum(axis=1)    # room for rounding


def tuned_probes(index: DataFrame, queries: DataFrame, k: int, dimensions: int, probes: Probes,
                 recall: float, sample: int) -> int:
    """So many probes that this share of the true neighbours of at most `sample` queries is found.

    The sample is chosen by the MD5 of the query's id; its neighbours are searched exactly in the whole index.
    """
    some = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").orderBy(
        F.md5(F.col("query_id").cast("string")), "query_id").limit(sample)
    some = materialize(some, "lsh-sample")
    true = knn_join(index, some, k + 1, dimensions).filter("key <> query_id").filter(F.col("rank") <= k + 1)
    true = first_n(true.drop("rank"), ["query_id"], [F.desc("score"), F.asc("key")], k, rank="rank")
    rows = true.join(index.select(F.col("key").cast("string").alias("key"), F.col("vector").alias("theirs")), "key").join(
        some, "query_id").select("vector", "theirs").collect()      # at most sample x k rows
    if not rows:
        return 1
    asked, theirs = (probes.margins(unit_rows(np.array([r[c] for r in rows], "float64"))) for c in ("vector", "theirs"))
    ranks = np.sort(probes.below(asked, probes.codes(theirs)))
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1


def lsh_candidates(index: DataFrame, queries: DataFrame, k: int, dimensions: int, bits: int | None = None,
                   probes: int | None = None, recall: float = 0.95, sample: int = 200, seed: int = 7,
                   slot_bytes: int = ASKED_BYTES) -> DataFrame:
    """Approximate k nearest other rows: exact search in the buckets a query probes.

    The number of signs follows the row count of the index, the number of probes
    the wanted recall, measured on a sample of the queries. A row is in one
    bucket, so its signature is computed once; no row of a bucket is left out.
    A key equal to the query's id is the query itself and is not returned.

    A task holds some queries while index rows pass. All are compared, by
    products of matrices; buckets and exact scores are looked at only for the few
    rows that come near a query's k-th best so far.
    """
    rows = index.count()
    signs = Probes(lsh_planes(bits or lsh_bits(rows), dimensions, seed))
    if probes is None:
        probes = tuned_probes(index, queries, k, dimensions, signs, recall, sample)
    some = _sample(index, "key", SAMPLE_ROWS, dimensions, rows)
    asked = materialize(lsh_limits(queries.filter("query_id is not null"), dimensions, signs, probes), "lsh-limits")
    left, right = lsh_groups(index.filter("key is not null"), asked, dimensions, signs, probes, rows,
                             prefix=best_prefix(signs, probes, some, rows))
    held = max(1, slot_bytes // (8 * dimensions))
    copies = max(1, -(-asked.count() // held))
    passing = -(-rows // -(-3 * index.sparkSession.sparkContext.defaultParallelism // copies))
    # A row per group, of which there are 2**PREFIX at most.
    sizes = F.broadcast(left.groupBy("bucket").agg(_number(max(512, min(PASSING_ROWS, passing)), "slots")).join(
        right.groupBy("bucket").agg(_number(held, "copies")), "bucket"))
    hits = _dealt(left, right, sizes, "queries").mapInArrow(_passing(dimensions, k, signs), HITS)
    return _merge(hits.filter("key <> query_id"), k)


def best_prefix(signs: Probes, probes: int, units: np.ndarray, rows: int) -> int:
    """By how many leading signs to group buckets, so that moving queries and comparing them take the least time."""
    if not len(units):
        return 0
    margins = signs.margins(units)
    limits = signs.limits(margins, probes)
    most = max(0, min(PREFIX, signs.bits, (rows // 512).bit_length() - 1))
    visits = [np.mean([len(g) for g in _groups(signs, margins, limits, n)]) for n in range(most + 1)]
    return int(np.argmin([v * (rows / 2 ** n + VISIT_PAIRS) for n, v in enumerate(visits)]))


def _groups(signs: Probes, margins: np.ndarray, limits: np.ndarray, prefix: int) -> list[np.ndarray]:
    """The groups that hold a bucket each row probes: if one does, so does the one with the row's own other signs."""
    flips = (np.arange(1 << prefix)[:, None] >> np.arange(prefix)) & 1
    rest = signs.bits - prefix
    near = margins[:, rest:] ** 2 @ flips.T <= limits[:, None]
    return [np.flatnonzero(n) ^ (code >> rest) for n, code in zip(near, signs.codes(margins))]


def lsh_buckets(index: DataFrame, queries: DataFrame, dimensions: int, signs: Probes,
                probes: int) -> tuple[DataFrame, DataFrame]:
    """Index rows with their bucket, and each query once per bucket it probes."""
    def own(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _with(batch, bucket=signs.codes(signs.margins(units)))

    def probed(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = signs.buckets(signs.margins(units), probes)
        yield from _repeated(batch, np.repeat(np.arange(len(found)), found.shape[1]), bucket=found.ravel())

    return (_units(index, "key", dimensions, "key string, vector array<float>, bucket long", own),
            _units(queries, "query_id", dimensions, "query_id string, vector array<float>, bucket long", probed,
                   at_once=256))


def lsh_limits(queries: DataFrame, dimensions: int, signs: Probes, probes: int) -> DataFrame:
    """Queries with the cost up to which they probe buckets, as `near`."""
    def limited(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _with(batch, near=signs.limits(signs.margins(units), probes))

    return _units(queries, "query_id", dimensions, "query_id string, vector array<float>, near double", limited)


def lsh_groups(index: DataFrame, queries: DataFrame, dimensions: int, signs: Probes, probes: int, rows: int,
               slot_bytes: int = SLOT_BYTES, prefix: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Index rows with the group of their bucket, and each query once per group it probes a bucket of.

    A group is all buckets with the same `prefix` leading signs, by default as
    many as fill a slot, so a query that probes thousands of buckets takes its
    vector to few places. A row's bucket and a query's limit go along as `near`;
    queries may bring theirs.
    """
    if prefix is None:
        prefix = min(signs.bits, PREFIX, (-(-rows // _slot_rows(slot_bytes, dimensions, rows)) - 1).bit_length())

    def own(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = signs.codes(signs.margins(units))
        yield _with(batch, bucket=codes >> (signs.bits - prefix), near=codes.astype("float64"))

    if "near" not in queries.columns:
        queries = lsh_limits(queries, dimensions, signs, probes)

    def probed(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = _groups(signs, signs.margins(units), batch.column("near").to_numpy(), prefix)
        query = np.repeat(np.arange(len(found)), [len(g) for g in found])
        yield from _repeated(batch, query, bucket=np.concatenate(found))

    left = _units(index, "key", dimensions, "key string, vector array<float>, bucket long, near double", own)
    right = _units(queries, "query_id", dimensions, "query_id string, vector array<float>, near double, bucket long", probed,
                   "near", at_once=256)
    return left.select("bucket", "key", "vector", "near"), right.select(
        "bucket", "query_id", "vector", "near", F.lit(float("-inf")).alias("least"))


def _passing(dimensions: int, k: int, signs: Probes) -> Callable:
    """Rows come sorted by place, queries of a place before its index rows, those by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, asked = None, [], None
        for place, kind, names, ids, units, near, _ in _runs(batches, dimensions):
            if place != now:
                if asked:
                    yield asked.found()
                now, parts, asked = place, [], None
            if not kind:
                parts.append((ids, units, near))
            elif parts:
                asked = asked or Asked(signs, k, *(np.concatenate(x) for x in zip(*parts)))
                asked.add(names, ids, units, near)
        if asked:
            yield asked.found()

    return run


class Asked:
    """Queries of one place, and the best k so far of the rows in the buckets each probes.

    Scores are first taken in single precision; a row is looked at closely if it
    may reach a query's k-th. Rows come in the order of their keys, so their number settles ties.
    """

    QUERIES, FIRST, ROWS = 1024, 512, 1024      # slice of the score matrix held at a time; the first one is smaller
    PAIRS = 1 << 14                             # looked at closely at a time
    NEAR = 2e-5                                 # room for single precision and for rounding to six digits

    def __init__(self, signs: Probes, k: int, ids: np.ndarray, units: np.ndarray, limits: np.ndarray):
        margins = signs.margins(units)
        self.signs, self.k, self.ids, self.units, self.limits = signs, k, ids, units, limits
        self.single, self.costs, self.codes = units.astype("float32"), margins ** 2, signs.codes(margins)
        self.scores, self.rows = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.names: list[pa.Array] = []
        self.seen = self.close = 0

    def add(self, names: pa.Array, keys: np.ndarray, units: np.ndarray, codes: np.ndarray) -> None:
        """The next index rows."""
        self.names.append(names)
        single, codes = units.astype("float32"), codes.astype(np.int64)
        at = 0
        while at < len(keys):
            size = min(self.ROWS, max(self.FIRST, self.seen // 8 * 8))
            part = slice(at, at + size)
            for first in range(0, len(self.ids), self.QUERIES):
                self._slice(first, single[part], keys[part], units[part], codes[part])
            self.seen += len(keys[part])
            at += size

    def _slice(self, first: int, single: np.ndarray, *rows: np.ndarray) -> None:
        some = slice(first, first + self.QUERIES)
        scores = self.single[some] @ single.T
        cut = (self.scores[some, -1] - self.NEAR).astype("float32")
        few = np.flatnonzero(np.isneginf(cut))      # queries that have not found k rows yet
        n = scores.shape[1]
        most = min(n, 4 * self.k)
        if not len(few) or most == n:
            self._look(first, *self._where(scores >= cut[:, None]), *rows)
            return
        # The best few of this slice first; if they hold k rows in probed buckets, no worse row counts.
        cut[few] = np.partition(scores[few], n - most, axis=1)[:, n - most]
        self._look(first, *self._where(scores >= cut[:, None]), *rows)
        now = (self.scores[some, -1][few] - self.NEAR).astype("float32")
        few, now = few[now < cut[few]], now[now < cut[few]]
        if len(few):
            left = (scores[few] < cut[few][:, None]) & (scores[few] >= now[:, None])
            left &= self._probed(first + few, rows[2])
            query, row = np.nonzero(left)
            self._look(first, few[query], row, *rows)

    @staticmethod
    def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the few true values of a matrix, found eight at a time."""
        if mask.shape[1] % 8:
            mask = np.pad(mask, ((0, 0), (0, -mask.shape[1] % 8)))
        words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
        word, byte = np.nonzero(mask.reshape(-1, 8)[words])
        return np.divmod(words[word] * 8 + byte, mask.shape[1])

    def _probed(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether each query probes the bucket of each row, in one product: signs that differ add their cost."""
        bits = np.arange(self.signs.bits)
        own, theirs = ((c[:, None] >> bits) & 1 for c in (self.codes[queries], codes))
        costs = self.costs[queries]
        return (costs * own).sum(axis=1)[:, None] + (costs * (1 - 2 * own)) @ theirs.T <= self.limits[queries][:, None]

    def _look(self, first: int, queries: np.ndarray, found: np.ndarray, keys: np.ndarray, units: np.ndarray,
              codes: np.ndarray) -> None:
        """Rows in probed buckets, but the query itself, with their exact scores."""
        bits = np.arange(self.signs.bits)
        for at in range(0, len(queries), self.PAIRS):
            query, row = first + queries[at:at + self.PAIRS], found[at:at + self.PAIRS]
            flips = ((self.codes[query] ^ codes[row])[:, None] >> bits) & 1
            near = ((self.costs[query] * flips).sum(axis=1) <= self.limits[query]) & (keys[row] != self.ids[query])
            self.close += len(query)
            query, row = query[near], row[near]
            score = np.round(np.einsum("ij,ij->i", self.units[query], units[row]), 6) + 0.0
            reached = score >= self.scores[query, -1]
            if reached.any():
                self._keep(query[reached], score[reached], self.seen + row[reached])

    def _keep(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        changed, of = np.unique(query, return_inverse=True)
        of = np.concatenate([of, np.repeat(np.arange(len(changed)), self.k)])
        score = np.concatenate([score, self.scores[changed].ravel()])
        row = np.concatenate([row, self.rows[changed].ravel()])
        order = np.lexsort((row, -score, of))
        starts = np.searchsorted(of[order], np.arange(len(changed)))
        best = order[np.arange(len(order)) - starts[of[order]] < self.k]
        self.scores[changed], self.rows[changed] = (x[best].reshape(-1, self.k) for x in (score, row))

    def found(self) -> pa.RecordBatch:
        query, place = np.nonzero(np.isfinite(self.scores))
        keys = pa.concat_arrays(self.names).take(pa.array(self.rows[query, place]))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query], pa.string()), keys, pa.array(self.scores[query, place])], ["query_id", "key", "score"])
