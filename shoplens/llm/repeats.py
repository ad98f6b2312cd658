"""Repeated byte strings, by ranks of the strings whose sampled gram can repeat.

Not the sort of position and rank pairs at growing offsets: there is no Spark
sort of positions and no round of reranking. Ranks are hashes, made next to
the text.

1. Texts are gathered in blocks of a few MB, written once. Every string of
   `length` bytes has a sample: the place in it whose `gram` bytes hash lowest.
   Equal strings have equal samples at equal places, so a string whose sample
   stands nowhere else is unique. The first exchange finds the samples that do.
2. The second exchange takes what surrounds them to the bucket of the gram,
   each context once a block. There the strings get their ranks by doubling
   (1, 2, 4, ... bytes and an overlap up to `length`), and numpy sorts them
   within the bucket. A gram with very many contexts sends the ranks of its
   strings instead, each to the bucket of the rank.
3. A block gets back which strings also start in a smaller document.

Ranks are 64-bit hashes of the bytes they stand for, so that blocks agree on
them without a common table; strings are compared by 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import id_and_text, mix64, offsets
from shoplens.session import materialize

BLOCKS = "block string, doc_ids binary, starts binary, data binary"
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_STRETCH = 1 << 14  # places worked on together: their arrays stay in the processor's cache


def _pack_blocks(docs: DataFrame, size: int) -> DataFrame:
    """Texts in blocks of about `size` bytes; a block's name is a digest of what it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int] = []
        rows: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            data = b"".join(rows)
            ids = np.array(names, "<i8").tobytes()
            starts = offsets([len(r) for r in rows]).astype("<i8").tobytes()
            name = hashlib.sha256(ids + starts + data).hexdigest()
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (name, ids, starts, _zip(data))],
                ["block", "doc_ids", "starts", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(doc_id)
                rows.append(text.encode("utf-8", "surrogatepass"))
                held += len(rows[-1])
                if held >= size or len(rows) >= 65536:
                    yield flush()
                    names, rows, held = [], [], 0
        if rows:
            yield flush()

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """The bytes of a block's documents."""

    def __init__(self, doc_ids: bytes, starts: bytes, data: bytes):
        self.doc_ids = np.frombuffer(doc_ids, "<i8")
        self.starts = np.frombuffer(starts, "<i8")
        self.bytes = np.frombuffer(_unzip(data), np.uint8)

    def owners(self, length: int, gram: int):
        """Places that are the sample of some string, their first and last string, and their grams.

        The strings that have their sample at a place start side by side.
        """
        starts, place, grams = self.samples(length, gram)
        turn = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        places, low = place[turn], starts[turn]
        return places, low, np.append(starts[turn[1:] - 1], starts[-1:]), grams[places]

    def samples(self, length: int, gram: int):
        """Starts of all strings inside documents, each one's sampled place, and keys of grams.

        A sampled gram has a low rank, so the keys that deal grams out are the
        ranks scrambled once more.
        """
        grams = ranks(self.bytes, gram)
        n = len(self.bytes) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), mix64(grams ^ _B)
        # The high bits of the rank, then the place: of equal ranks the leftmost is least.
        bits = np.uint64(len(grams).bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        width, place = length - gram + 1, np.empty(n, np.int64)
        for at in range(0, n, _STRETCH):
            best = grams[at:min(at + _STRETCH, n) + width - 1] & ~low
            best |= np.arange(at, at + len(best), dtype=np.uint64)
            m = 1
            while m < width:
                step = min(m, width - m)
                best = np.minimum(best[:-step], best[step:])
                m += step
            place[at:at + len(best)] = best & low
        inside = np.ones(n, bool)
        for edge in self.starts[1:-1].tolist():
            inside[max(0, edge - length + 1):min(edge, n)] = False
        starts = np.flatnonzero(inside)
        return starts, place[starts], mix64(grams ^ _B)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(6).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def ranks(data: np.ndarray, size: int, multiplier: np.uint64 = _A) -> np.ndarray:
    """Ranks of `size` bytes at every position they fit, by doubling.

    The rank of 2m bytes is made of those of m bytes at offsets 0 and m; a size
    between two powers of two of the largest such m, overlapping.
    """
    bytes_ = mix64(np.arange(1, 257, dtype=np.uint64) * multiplier)
    out = np.empty(max(0, len(data) - size + 1), np.uint64)
    for at in range(0, len(out), _STRETCH):
        one = bytes_[data[at:at + _STRETCH + size - 1]]
        m = 1
        while m < size:
            step = min(m, size - m)
            right = one[step:] >> np.uint64(29)
            right ^= one[step:]
            right *= multiplier
            one = one[:-step] * _A
            one += right
            m += step
        out[at:at + _STRETCH] = mix64(one)
    return out


def _deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted 64-bit keys: ranges of equal width."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _contexts(block: Block, places: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int):
    """What surrounds each sampled place, as far as strings with that sample reach.

    A row has room for all strings that can have their sample there. It holds
    the bytes of those that do, zeros elsewhere, and which ones they are.
    """
    reach = length - gram
    owner = np.searchsorted(block.starts, places, side="right") - 1
    rows = np.zeros((len(places), length + reach + 2), np.uint8)
    for at in range(0, len(places), 1 << 15):
        p, first, last = (x[at:at + (1 << 15)] for x in (places, low, high))
        where = p[:, None] + np.arange(-reach, length)
        outside = (where < first[:, None]) | (where >= last[:, None] + length)
        rows[at:at + len(p), :-2] = np.where(outside, 0, block.bytes[np.clip(where, 0, len(block.bytes) - 1)])
    rows[:, -2], rows[:, -1] = places - high, places - low
    return rows, block.doc_ids[owner]


def _row_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(words.shape[1]):
        out = mix64(out * _B + words[:, i] + _A)
    return out


def _strings(rows: np.ndarray, length: int, gram: int):
    """All strings of rows of `_contexts`: row, steps from start to place, and two ranks of their bytes."""
    reach = length - gram
    # strings `steps` bytes before the place, from the nearest to the farthest that it owns
    spread = rows[:, -1].astype(np.int64) - rows[:, -2] + 1
    row = np.repeat(np.arange(len(rows)), spread)
    steps = rows[:, -2].astype(np.int64)[row] + np.arange(len(row)) - np.repeat(offsets(spread)[:-1], spread)
    flat = np.ascontiguousarray(rows[:, :-2]).reshape(-1)
    where = row * (length + reach) + reach - steps
    return row, steps, ranks(flat, length)[where], (ranks(flat, length, _B)[where] >> np.uint64(32)).astype(np.uint32)


def _answer(places: np.ndarray, masks: np.ndarray) -> bytes:
    """Places, and for each the steps back to the starts of its strings that go."""
    return _zip(places.astype("<u4").tobytes() + masks.astype("<u8").tobytes())


def _least(first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every entry the smallest document of all entries with its two keys."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    out = np.empty(len(a), np.int64)
    if len(a):
        out[order] = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20, id_col: str = "doc_id",
                   text_col: str = "text", block_bytes: int = 4 << 20,
                   buckets: int | None = None, with_text: bool = False, most: int = 1 << 13) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a smaller document.

    Texts are UTF-8, null is empty, strings never cross documents, and all are
    judged on the input. Rows of equal id do not remove from each other; a null
    id counts as the smallest number. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256, with `with_text` also the bytes kept.
    A sampled gram with more than `most` contexts is judged string by string.
    `length` may exceed `gram` by 63 at most, as the answers are words of 64 bits;
    other lengths are refused.
    """
    if not 0 <= length - gram <= 63:
        raise ValueError(f"length {length} must exceed gram {gram} by 0 to 63")
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    null_id = -(1 << 63)
    reach = length - gram
    texts = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(null_id)).alias("doc_id"), "text")
    table = materialize(_pack_blocks(texts, block_bytes), "blocks")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                doc_ids, starts, data = (row.column(n)[0].as_py() for n in ("doc_ids", "starts", "data"))
                yield Block(doc_ids, starts, data), row

    def by_bucket(name: str, payloads: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
        used = list(payloads)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array([i for i, _ in used], pa.int32()),
             pa.array([data for _, data in used], pa.binary())], ["block", "bucket", "data"])

    def send_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in opened(batches):
            places, low, high, grams = block.owners(length, gram)
            own, at, count = np.unique(grams, return_inverse=True, return_counts=True)
            # Equal contexts of a block are sent once; few places are not worth looking.
            many = np.flatnonzero(count[at] > 16)
            if len(many):
                rows, _ = _contexts(block, places[many], low[many], high[many], length, gram)
                _, first = np.unique(_row_keys(rows), return_index=True)
                count = np.where(count > 16, np.bincount(at[many][first], minlength=len(own)), count)
            # 48 bits decide whether a string is looked at; false matches only cost time
            short = (own >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            cuts = _deal(own, buckets).tolist()
            yield by_bucket(row.column("block")[0].as_py(), (
                (i, np.array([b - a], "<i8").tobytes() + short[a:b].tobytes() + _zip(count[a:b].astype("<u4").tobytes()))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b))

    def shared(table: pa.Table) -> pa.Table:
        """Of the samples of each block in this bucket: which stand in another block too, and which have too many contexts."""
        keys, counts = [], []
        for cell in table.column("data"):
            data = cell.as_py()
            n = int.from_bytes(data[:8], "little")
            keys.append(np.pad(np.frombuffer(data, np.uint8, 6 * n, 8).reshape(-1, 6), ((0, 0), (0, 2))).reshape(-1).view("<u8"))
            counts.append(np.frombuffer(_unzip(data[8 + 6 * n:]), "<u4"))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        twice = np.empty(len(every), bool)
        twice[order] = np.append(False, same) | np.append(same, False)
        new = np.append(True, ~same)
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), np.flatnonzero(new))
        heavy = np.empty(len(every), bool)
        heavy[order] = (total > most)[np.cumsum(new) - 1]
        cuts = offsets([len(k) for k in keys])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(
            [np.packbits(twice[a:b]).tobytes() + np.flatnonzero(heavy[a:b]).astype("<u4").tobytes()
             for a, b in zip(cuts, cuts[1:])], pa.binary())})

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in opened(batches):
            name = row.column("block")[0].as_py()
            places, low, high, grams = block.owners(length, gram)
            own, at, count = np.unique(grams, return_inverse=True, return_counts=True)
            cuts = _deal(own, buckets)
            again, heavy = count > 1, np.zeros(len(own), bool)
            for mark in row.column("marks")[0].as_py():
                a, b = cuts[mark["bucket"]], cuts[mark["bucket"] + 1]
                bits = int(b - a + 7) // 8
                again[a:b] |= np.unpackbits(np.frombuffer(mark["data"], np.uint8, bits), count=int(b - a)).astype(bool)
                heavy[a + np.frombuffer(mark["data"], "<u4", offset=bits)] = True
            chosen = np.flatnonzero((again | heavy)[at])
            chosen = chosen[np.argsort(at[chosen], kind="stable")]
            places, at = places[chosen], at[chosen]
            rows, doc_ids = _contexts(block, places, low[chosen], high[chosen], length, gram)
            keys = _row_keys(rows)
            # All strings go where a smaller document of the block has the same context; the others ask.
            copy = doc_ids > _least(keys, np.zeros(len(keys), np.uint32), doc_ids)
            nearest, farthest = (rows[copy, i].astype(np.uint64) for i in (-2, -1))
            known = [(places[copy], (np.uint64(2) << farthest) - (np.uint64(1) << nearest))]
            asks = ~copy & ~heavy[at]
            split = ~copy & heavy[at]
            # A gram with too many contexts sends its strings, each to the bucket of its own rank.
            which, steps, first, second = _strings(rows[split], length, gram)
            begins, owner = places[split][which] - steps, doc_ids[split][which]
            copy = owner > _least(first, second, owner)
            known.append((begins[copy], np.ones(int(copy.sum()), np.uint64)))
            order = np.flatnonzero(~copy)
            order = order[np.argsort(first[order], kind="stable")]
            first, second, begins, owner = first[order], second[order], begins[order], owner[order]
            dealt = _deal(first, buckets).tolist()
            rows, keys, places, at, doc_ids = rows[asks], keys[asks], places[asks], at[asks], doc_ids[asks]
            cuts = np.searchsorted(at, cuts).tolist()

            def payload(a: int, b: int, c: int, d: int) -> bytes:
                _, one, which = np.unique(keys[a:b], return_index=True, return_inverse=True)
                parts = [rows[a:b][one]] + [x.astype(t) for x, t in (
                    (which, "<u4"), (places[a:b], "<u4"), (doc_ids[a:b], "<i8"), (first[c:d], "<u8"),
                    (second[c:d], "<u4"), (begins[c:d], "<u4"), (owner[c:d], "<i8"))]
                return np.array([len(one), b - a, d - c], "<i8").tobytes() + _zip(b"".join(x.tobytes() for x in parts))

            yield by_bucket(name, ((i, payload(a, b, c, d)) for i, (a, b, c, d) in enumerate(
                zip(cuts, cuts[1:], dealt, dealt[1:])) if a < b or c < d))
            if any(len(x) for x, _ in known):
                # what needs no bucket comes back with the answers, by any of them
                settled = _answer(*(np.concatenate(x) for x in zip(*known)))
                yield by_bucket(name, iter([(int(name[:8], 16) % buckets, np.array([-1, 0, 0], "<i8").tobytes() + settled)]))

    def judge(table: pa.Table) -> pa.Table:
        """For each place: which of its strings also start in a smaller document."""
        width = length + reach + 2
        types = ("<u4", "<u4", "<i8", "<u8", "<u4", "<u4", "<i8")
        contexts, columns, sizes, settled = [], [], [], {}
        known = 0
        for cell in table.column("data"):
            data = cell.as_py()
            n, m, k = np.frombuffer(data[:24], "<i8").tolist()
            if n < 0:
                settled[len(sizes)], n, data = data[24:], 0, b""
            else:
                data = _unzip(data[24:])
            contexts.append(np.frombuffer(data[:n * width], np.uint8).reshape(n, width))
            at, read = n * width, []
            for size, kind in zip((m, m, m, k, k, k, k), types):
                read.append(np.frombuffer(data[at:at + size * int(kind[2])], kind))
                at += read[-1].nbytes
            read[0] = read[0].astype(np.int64) + known
            columns.append(read)
            known += n
            sizes.append((m, k))
        which, places, doc_ids, rank, more, begins, owner = (np.concatenate(x) for x in zip(*columns))
        columns.clear()
        least = np.full(known, 1 << 62, np.int64)
        np.minimum.at(least, which, doc_ids)
        at, back, first, second, done = [np.zeros(0, np.int32)], [np.zeros(0, np.int8)], [rank[:0]], [more[:0]], 0
        for part in contexts:
            for begin in range(0, len(part), 1 << 14):
                rows = part[begin:begin + (1 << 14)]
                row, steps, one, two = _strings(rows, length, gram)
                first.append(one)
                second.append(two)
                at.append((row + done).astype(np.int32))
                back.append(steps.astype(np.int8))
                done += len(rows)
        at, back = np.concatenate(at), np.concatenate(back)
        smallest = _least(np.concatenate(first), np.concatenate(second), least[at])
        per_string = np.full((known, reach + 1), 1 << 62, np.int64)
        per_string[at, back] = smallest
        masks = np.zeros(len(which), np.uint64)
        for step in range(reach + 1):
            masks |= (per_string[which, step] < doc_ids).astype(np.uint64) << np.uint64(step)
        gone = _least(rank, more, owner) < owner
        cuts, ends = offsets([m for m, _ in sizes]).tolist(), offsets([k for _, k in sizes]).tolist()
        answers = []
        for i in range(len(sizes)):
            own, single = slice(cuts[i], cuts[i + 1]), slice(ends[i], ends[i + 1])
            hit, lost = masks[own] > 0, begins[single][gone[single]]
            answers.append(settled[i] if i in settled else _answer(
                np.append(places[own][hit], lost), np.append(masks[own][hit], np.ones(len(lost), np.uint64))))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "data": pa.array(answers, pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in opened(batches):
            size = len(block.bytes)
            edges = np.zeros(size + 1, np.int32)
            for answer in row.column("answers")[0].as_py() or []:
                data = _unzip(answer["data"])
                n = len(data) // 12
                places = np.frombuffer(data, "<u4", n).astype(np.int64)
                masks = np.frombuffer(data, "<u8", n, 4 * n)
                for step in range(reach + 1):
                    gone = places[(masks >> np.uint64(step)) & np.uint64(1) == 1] - step
                    np.add.at(edges, gone, 1)
                    np.add.at(edges, gone + length, -1)
            covered = np.cumsum(edges)[:size] > 0
            removed = offsets(covered)
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            inner = block.starts[1:-1]
            inner = inner[inner < size]
            begins[inner] = covered[inner]
            spans = offsets(begins)
            a, b = block.starts[:-1], block.starts[1:]
            kept = block.bytes[~covered].tobytes()
            x, y = a - removed[a], b - removed[b]
            parts = [kept[i:j] for i, j in zip(x.tolist(), y.tolist())]
            columns = [pa.array([None if i == null_id else i for i in block.doc_ids.tolist()], pa.int64()),
                       pa.array(b - a), pa.array(removed[b] - removed[a]), pa.array(spans[b] - spans[a]),
                       pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(parts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    message = "block string, bucket int, data binary"

    def exchanged(sent: DataFrame, answer, name: str) -> DataFrame:
        """What the buckets answer, gathered by block."""
        dealt = sent.repartitionById(buckets, F.col("bucket"))
        return dealt.groupBy("bucket").applyInArrow(answer, message).groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("bucket", "data"))).alias(name))

    marks = exchanged(table.mapInArrow(send_samples, message), shared, "marks")
    answers = exchanged(table.join(marks, "block").mapInArrow(send_contexts, message), judge, "answers")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return table.join(answers, "block", "left").mapInArrow(
        cut, schema + (", kept binary" if with_text else ""))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 49)) AS pos FROM d WHERE n >= 50),
s AS (SELECT w.doc_id, pos, substr(h, 2 * pos + 1, 100) AS x FROM w JOIN d USING (doc_id)),
m AS (SELECT x, min(doc_id) AS least FROM s GROUP BY x HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT s.doc_id, pos FROM s JOIN m USING (x) WHERE least < s.doc_id),
o AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM g),
i AS (SELECT doc_id, pos, sum(CASE WHEN prev IS NULL OR pos > prev + 50 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM o),
r AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM
  (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, -1 AS a, 0 AS b FROM d)),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * k.a + 1, 2 * (coalesce(k.b, n) - k.a)), '' ORDER BY k.a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
