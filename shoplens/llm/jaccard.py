"""Near duplicates by a size-aware heavy-light join on word shingles.

Every document is the set of its shingles. All sets share one order of
shingles: those that stand in many documents last, the others by hash. If two
sets are similar enough, the first n - ceil(t n) + k shingles of each (n: its
size) have at least k in common. So

* a light set (small) lists all pairs of shingles of its prefix for k = 2, and
  meets other light sets that list one of the same pairs;
* a heavy set (large) scans the inverted lists of its prefix for k = 1, in
  which heavy sets stand, and light ones that are near in size.

The boundary is the size at which listing pairs stops being cheaper than
scanning lists, from counts over all documents. Candidates are then checked on
their whole sets.

Only links that can join two components are needed. Documents with equal sets
are one from the start. A short list gives all its pairs; a long one first ties
its documents to the smallest of them. After the components of what was found,
the documents of a long list that are still in different components are compared
with each other: nothing is left out, and copies are not expanded into pairs.
Documents are compared in cells, blocks of bounded size that meet in one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.components import components
from shoplens.llm.common import give_back, giving_back, mix64, offsets, portions_of, worker_cache
from shoplens.session import materialize

WORDS = 5
THRESHOLD = (75, 100)  # 100 * intersection >= 75 * union
CELL = ["tie", "low", "high"]       # a group of documents to compare, and two of its blocks
CELL_DOCUMENTS = 256                # about so many in a block
CELL_SHINGLES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 2 ** 64)
_Q = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix64((_LOWER + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _pieces(data: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes, cut before blanks; a longer word stays whole."""
    start = 0
    while len(data) - start > most:
        found = _BLANKS.search(data, start + most)
        if found is None:
            break
        yield data[start:found.start()]
        start = found.start()
    yield data[start:]


def _words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of some pieces of text, and where each piece's words start (plus the end)."""
    raw = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    edges = offsets([len(p) + 1 for p in pieces])
    blank = _BLANK[raw]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(raw) and not blank[0]:
        change = np.append(0, change)
    begin, end = change[::2], change[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(np.where(blank, np.uint64(0), _BYTE[raw]) * _powers(_P, len(raw)), out=sums[1:], dtype=np.uint64)
    hashed = (sums[end] - sums[begin]) * _powers(_P_INVERSE, len(raw))[begin]
    return mix64(hashed + (end - begin).astype(np.uint64) * _Q), np.searchsorted(begin, edges)


def shingle_sets(texts: list[str], words: int = WORDS, most: int = 1 << 18) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are runs of other characters than blanks, A-Z in lower case. A text
    with fewer words than a shingle is one shingle, one without words none.
    Words are hashed in pieces of about `most` bytes, whatever the length of a text.
    """
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for piece in _pieces(t.encode("utf-8", "surrogatepass"), most):
            pieces.append(piece)
            owner.append(i)
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for start, stop in portions_of([len(p) + 1 for p in pieces], most):
        found, starts = _words(pieces[start:stop])
        hashes.append(found)
        np.add.at(counts, owner[start:stop], np.diff(starts))
    hashed, at = np.concatenate(hashes), offsets(counts)  # words of each text
    long = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for j in range(words):
        long = long * _Q + hashed[j:j + len(long)]
    long = mix64(long)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(long[a:b - words + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for j in range(a, b):
                one = one * _Q + hashed[j:j + 1]
            out.append(mix64(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that stand for a set, from sums that do not depend on its order."""
    lens = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    halves = []
    for salt in (_Q, np.uint64(0xA0761D6478BD642F)):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix64(flat ^ salt), out=sums[1:], dtype=np.uint64)
        at = offsets(lens)
        halves.append(mix64(sums[at[1:]] - sums[at[:-1]] + lens.astype(np.uint64)))
    return [a.tobytes() + b.tobytes() for a, b in zip(*halves)]


def needed(n: int) -> int:
    """How many of its n shingles a set must share with any set it links to."""
    part, whole = THRESHOLD
    return -(-part * n // whole)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    part, whole = THRESHOLD
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def _distinct_sets(doc_ids: list[int], texts: list[str]):
    """The different sets of a portion, each with its smallest document."""
    sets = shingle_sets(texts)
    first: dict[bytes, int] = {}
    for i, digest in enumerate(_digests(sets)):
        if len(sets[i]) and (digest not in first or doc_ids[i] < doc_ids[first[digest]]):
            first[digest] = i
    return [(doc_ids[i], sets[i]) for i in first.values()]


def _rows(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in portions of about `most` bytes; only one is in Python at a time."""
    worker_cache("jaccard")
    give_back()
    for start, stop in portions_of(pc.binary_length(batch.column(1)).to_pylist(), most):
        some = batch.slice(start, stop - start)
        yield some.column(0).to_pylist(), some.column(1).to_pylist()


def documents_and_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the set's digest (null for an empty set) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, texts in _rows(batch):
                sets = shingle_sets(texts)
                digests = [d if len(s) else None for d, s in zip(_digests(sets), sets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary())], ["doc_id", "n_shingles", "digest"])

    return docs.mapInArrow(giving_back(run), "doc_id long, n_shingles long, digest binary")


def frequent(docs: DataFrame, least: int = 32, most: int = 1 << 17) -> np.ndarray:
    """Shingles that stand in many documents, the rarest of them first.

    This only orders shingles, so it decides how long the lists get and never
    which documents link: at most `most` are sent to the tasks, and shingles
    that a task has not seen shortly before need not be counted.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marked = np.zeros(1 << 25, bool), 0
        for some in (x for batch in batches for x in _rows(batch, 1 << 20)):
            held = [s for _, s in _distinct_sets(*some)]
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, int)
            counts = np.diff(np.append(starts, len(every)))
            every = every[starts]
            place = (every >> np.uint64(39)).astype(np.int64)
            again = seen[place] | (counts > 1)
            if marked > 1 << 22:
                seen[:], marked = False, 0
            seen[place] = True
            marked += len(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(every[again].view(np.int64)), pa.array(counts[again].astype(np.int64))],
                ["shingle", "n"])

    counted = docs.mapInArrow(giving_back(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    if not rows.num_rows:
        return np.zeros(0, np.uint64)
    return rows.column("shingle").to_numpy().view(np.uint64)[::-1].copy()


def boundary(sizes: dict[int, int], candidates_per_posting: float, largest: int = 64) -> int:
    """The largest size of light sets, by cost.

    A light set of size n costs a row per pair of its prefix, a heavy one a row
    per shingle of its prefix and the candidates its lists give; light sets
    within reach of heavy ones pay both.
    """
    part, whole = THRESHOLD
    best, found = None, 0
    for limit in range(0, largest + 1):
        cost = 0.0
        for n, count in sizes.items():
            prefix = n - needed(n) + 1
            if 3 <= n <= limit:
                cost += count * prefix * (prefix + 1) / 2
            if n > limit or whole * n >= part * (limit + 1):
                cost += count * prefix * (1 + candidates_per_posting)
        if best is None or cost < best:
            best, found = cost, limit
    return found


def _bucket_count(known: DataFrame, light: int, least: int, most: int = 1 << 18) -> int:
    """So many buckets that one gets about `most` postings, and `least` at least."""
    part, whole = THRESHOLD
    n = F.col("n_shingles")
    prefix = n - F.ceil(n * part / whole)
    made = F.when(n <= light, (prefix + 2) * (prefix + 1) / 2).otherwise(0) + F.when(
        (n > light) | (whole * n >= part * (light + 1)), prefix + 1).otherwise(0)
    total = known.where("n_shingles >= 3").agg(F.sum(made)).first()[0] or 0
    return max(least, -(-int(total) // most))


def _postings(docs: DataFrame, common: np.ndarray, light: int, buckets: int, short: int) -> DataFrame:
    """For each portion and bucket: keys of lists, documents and sizes (negative: light).

    A bucket gets so many of a portion's entries of one list, smallest documents
    first, that it sees that the list is long. Longer runs also travel whole, with
    their portion (`own`), to a bucket of no meaning.
    """
    order = np.argsort(common)
    ordered = common[order]

    def prefix(shingles: np.ndarray, ranks: np.ndarray, k: int) -> np.ndarray:
        n = len(shingles)
        want = n - needed(n) + k
        hot = ranks >= 0
        if not hot.any():
            return shingles[:want]
        rare = shingles[~hot][:want]
        if len(rare) == want:
            return rare
        later = shingles[hot][np.argsort(ranks[hot])]
        return np.concatenate([rare, later[:want - len(rare)]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, sizes, counts = [], [], [], []
            for doc_ids, texts in _rows(batch):
                for doc_id, shingles in _distinct_sets(doc_ids, texts):
                    n = len(shingles)
                    if n < 3:
                        continue  # a different set cannot be similar enough
                    if len(ordered):
                        at = np.minimum(np.searchsorted(ordered, shingles), len(ordered) - 1)
                        ranks = np.where(ordered[at] == shingles, order[at], -1)
                    else:
                        ranks = np.full(n, -1)
                    made = []
                    if n <= light:
                        start = prefix(shingles, ranks, 2)
                        i, j = np.triu_indices(len(start), 1)
                        low, high = np.minimum(start[i], start[j]), np.maximum(start[i], start[j])
                        made.append(mix64(low * _Q + mix64(high) + np.uint64(1)))
                    if n > light or THRESHOLD[1] * n >= THRESHOLD[0] * (light + 1):
                        made.append(mix64(prefix(shingles, ranks, 1)))
                    for m in made:
                        keys.append(m)
                        counts.append(len(m))
                        names.append(doc_id)
                        sizes.append(-n if n <= light else n)
            if not keys:
                continue
            keys = np.concatenate(keys)
            names = np.repeat(np.array(names, np.int64), counts)
            sizes = np.repeat(np.array(sizes, np.int32), counts)
            # a light set's pairs and single shingles share the sign; only pairs of lists tell them apart
            place = np.lexsort((names, keys))
            keys, names, sizes = keys[place], names[place], sizes[place]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            lens = np.diff(np.append(starts, len(keys)))
            run = np.repeat(lens > short + 1, lens)
            if run.any():
                own = [x[run] for x in (keys, names, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(mix64(own[0][:1] ^ own[1][:1].view(np.uint64))[0]) % buckets], pa.int32())] + [
                        pa.array([x.tobytes()], pa.binary()) for x in own] + [pa.array([True])],
                    ["bucket", "keys", "names", "sizes", "own"])
            stay = np.arange(len(keys)) - np.repeat(starts, lens) <= short
            keys, names, sizes = keys[stay], names[stay], sizes[stay]
            edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            used = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32())] + [
                    pa.array([x[cuts[i]:cuts[i + 1]].tobytes() for i in used], pa.binary())
                    for x in (keys, names, sizes)] + [pa.array([False] * len(used))],
                ["bucket", "keys", "names", "sizes", "own"])

    return docs.mapInArrow(giving_back(deal), "bucket int, keys binary, names binary, sizes binary, own boolean")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sizes allow a link."""
    part, whole = THRESHOLD
    a, b = np.abs(a.astype(np.int64)), np.abs(b.astype(np.int64))
    return whole * np.minimum(a, b) >= part * np.maximum(a, b)


def _scan_lists(postings: DataFrame, short: int) -> DataFrame:
    """Candidate pairs (key null) and the entries of long lists (b null)."""
    def entries(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, skip: int):
        """Pairs, and the list entries after the first `skip` of each list."""
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        lens = np.diff(np.append(starts, len(keys)))
        left, right = [], []
        for n in range(2, short + 1):
            own = starts[lens == n]
            i, j = np.triu_indices(n, 1)
            left.append((own[:, None] + i).ravel())
            right.append((own[:, None] + j).ravel())
        first = np.repeat(starts, lens)
        place = np.arange(len(keys)) - first
        inside = np.repeat(lens > short, lens) & (place >= skip)
        right.append(np.flatnonzero(inside & (place > 0)))
        left.append(first[right[-1]])
        left, right = np.concatenate(left), np.concatenate(right)
        keep = _near(sizes[left], sizes[right]) & (names[left] != names[right])
        rest = np.flatnonzero(inside)
        return np.stack([names[left[keep]], names[right[keep]]], 1), names[rest], keys[rest], sizes[rest]

    def scan(table: pa.Table) -> pa.Table:
        give_back()
        columns = [[np.frombuffer(v.as_py(), t) for v in table.column(n)] for n, t in (
            ("keys", np.uint64), ("names", np.int64), ("sizes", np.int32))]
        whole = table.column("own").to_pylist()
        found = [entries(*(x[i] for x in columns), short + 1) for i, own in enumerate(whole) if own]
        keys, names, sizes = (np.concatenate([x[:0] for x in column[:1]] + [
            x for x, own in zip(column, whole) if not own]) for column in columns)
        columns.clear()
        order = np.argsort(keys, kind="stable")
        again = keys[order]
        same = again[1:] == again[:-1]
        order = order[(np.append(False, same) | np.append(same, False))[:len(order)]]  # lists of two and more
        order = order[np.lexsort((names[order], keys[order]))]
        found.append(entries(keys[order], names[order], sizes[order], 0))
        pairs, names, keys, sizes = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(pairs, axis=0)
        nothing = pa.nulls(len(pairs), pa.int64())
        return pa.table({
            "a": pa.chunked_array([pa.array(pairs[:, 0]), pa.array(names)], pa.int64()),
            "b": pa.chunked_array([pa.array(pairs[:, 1]), pa.nulls(len(names), pa.int64())], pa.int64()),
            "key": pa.chunked_array([nothing, pa.array(keys.view(np.int64))], pa.int64()),
            "n": pa.chunked_array([nothing, pa.array(np.abs(sizes).astype(np.int64))], pa.int64())})

    return postings.groupBy("bucket").applyInArrow(scan, "a long, b long, key long, n long")


def _marks(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places with a mark for every id's hash; its size does not depend on the data."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.groupBy((place / 32).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))).alias("marks")).toArrow()
    out = np.zeros(1 << (bits - 5), np.int64)
    if words.num_rows:
        out[words.column("word").to_numpy()] = words.column("marks").to_numpy()
    return out.astype(np.uint32)


def _sketch(shingles: np.ndarray) -> bytes:
    """A bitmap with a mark for every shingle, four to eight places for each."""
    size = 1 << max(6, int(4 * len(shingles) - 1).bit_length())
    marks = np.zeros(size, bool)
    marks[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _may_link(n: np.ndarray, marks: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """Pairs (i, j) of `left` and `right` whose sets, of n shingles, can share enough.

    Shingles without a mark in the other set are not shared. A longer bitmap is
    folded to the length of the shorter; sizes that allow a link give bitmaps
    of one length, or of twice the length.
    """
    part, whole = THRESHOLD
    width = np.array([len(m) for m in marks])
    for w in np.unique(width[left]).tolist():
        xs = left[width[left] == w]
        for v in (w // 2, w, 2 * w):
            ys = right[width[right] == v]
            if not len(ys):
                continue
            x, y = np.stack([marks[i] for i in xs]), np.stack([marks[j] for j in ys])
            if v > w:
                y = y[:, :w] | y[:, w:]
            elif v < w:
                x = x[:, :v] | x[:, v:]
            of_x, of_y = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x, y))
            step = max(1, (1 << 17) // y.size)  # a megabyte at a time
            for s in range(0, len(xs), step):
                both = np.bitwise_count(x[s:s + step, None] & y[None]).sum(2, dtype=np.int64)
                size, other = n[xs[s:s + step], None], n[None, ys]
                most = np.minimum(size - (of_x[s:s + step, None] - both), other - (of_y[None] - both))
                i, j = np.nonzero(whole * most >= part * (size + other - most))
                yield xs[s + i], ys[j]


def _in_cells(rows: DataFrame, compare, schema: str) -> DataFrame:
    """What `compare` yields for each cell: its tie, low, high, then doc, block, component, n and value of its rows.

    Rows are dealt and sorted by cell, and a cell is taken when its last row is there.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            other = np.zeros(batch.num_rows, bool)
            for name in CELL:
                key = batch.column(name).to_numpy()
                other |= key != key[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                yield batch.slice(0, cut)
            rest = batch.slice(cut)
        if rest is not None:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_cells(batches):
            give_back()
            cells = np.stack([batch.column(c).to_numpy() for c in CELL], 1)
            starts = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1)))
            columns = [batch.column(c).to_numpy() for c in ("doc", "block", "component", "n")]
            values = batch.column("value")
            out = [np.zeros((0, len(names)), np.int64)]
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
                value = [np.frombuffer(values[i].as_buffer(), np.uint64) for i in range(start, stop)]
                out.append(compare(*cells[start].tolist(), *(c[start:stop] for c in columns), value))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in range(len(names))], names)

    columns = [*CELL, "block", "doc", "component", "n", "value"]
    return rows.select(*(F.col(c).cast("long") if c != "value" else F.col(c) for c in columns)).repartition(
        *CELL).sortWithinPartitions(*CELL).mapInArrow(giving_back(run), schema)


def _met(tie: int, low: int, high: int, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows on either side of a cell: the tie and the others, all and all, or one block and another."""
    every = np.arange(len(doc))
    if high < 0:
        return every[doc == tie], every[doc != tie]
    return (every, every) if low == high else (every[block == low], every[block == high])


def _possible(tie, low, high, doc, block, component, n, marks) -> np.ndarray:
    """The cell's documents that may link with one of another component; the values are bitmaps."""
    use = np.zeros(len(doc), bool)
    for i, j in _may_link(n, marks, *_met(tie, low, high, doc, block)):
        apart = component[i] != component[j]
        use[i[apart]] = use[j[apart]] = True
    found = np.unique(np.stack([doc[use], block[use], component[use]], 1), axis=0)
    return np.concatenate([np.tile(np.array([[tie, low, high]], np.int64), (len(found), 1)), found], 1)


def _joining(tie, low, high, doc, block, component, n, sets) -> np.ndarray:
    """Links of the cell that join its components as all its links would; the values are whole sets."""
    marks = [np.frombuffer(_sketch(s), np.uint64) for s in sets]
    _, label = np.unique(component, return_inverse=True)
    root = list(range(len(doc)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for left, right in _may_link(n, marks, *_met(tie, low, high, doc, block)):
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = find(label[i]), find(label[j])
            if a != b and linked(sets[i], sets[j]):
                root[a] = b
                out.append((doc[i], doc[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def _sets(docs: DataFrame, ids: DataFrame, sketch: bool, bits: int = 23) -> DataFrame:
    """doc, n and the set, or its bitmap, of at least the documents of `ids`.

    A bitmap of ids, bounded in size, keeps most other texts out of the joins;
    one that is full lets all of them through, and the joins decide.
    """
    marks = _marks(ids, bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column(2))
            batch = batch.filter(pa.array((marks[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1))
            for doc_ids, texts in _rows(batch):
                found = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(
                        [_sketch(s) if sketch else s.tobytes() for s in found], pa.binary())],
                    ["doc", "n", "value"])

    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("place"))
    return placed.mapInArrow(giving_back(sets), "doc long, n long, value binary")


def _links(docs: DataFrame, cells: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) that join the components in the cells as all links between documents that meet there would.

    First small bitmaps of the sets meet, which rules out most pairs that do
    not link and none that do. Documents that may link then meet in the same
    cell with their whole sets. Pairs are made in the tasks only: no row stands
    for a pair, and a cell yields fewer links than it has documents.
    """
    kinds = ", ".join(f"{c} long" for c in (*CELL, "doc", "block", "component"))
    may = materialize(_in_cells(cells.join(sketches, "doc"), _possible, kinds), "possible")
    whole = may.join(_sets(docs, may.select(F.col("doc").alias("doc_id")), False), "doc")
    return _in_cells(whole, _joining, "a long, b long")


def _blocks(documents: Column, shingles: Column) -> Column:
    """Into how many blocks a group goes, by its documents and the sum of their sizes."""
    return F.ceil(F.greatest(documents / CELL_DOCUMENTS, shingles / CELL_SHINGLES)).cast("int").alias("blocks")


def _block(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.col("blocks"))


def _star_cells(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Cells in which documents meet the smaller one they are paired with (`tie`), which stands in all its cells.

    Paired documents are near in size, so that of the tie tells the size of its cells.
    """
    n = F.count(F.lit(1))
    sized = pairs.join(first.select(F.col("rep").alias("a"), "n"), "a").groupBy("a").agg(_blocks(n, n * F.max("n")))
    others = pairs.join(sized, "a").select(F.col("a").alias("tie"), _block("b").alias("low"), F.col("b").alias("doc"))
    ties = sized.select(F.col("a").alias("tie"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("low"),
                        F.col("a").alias("doc"))
    return others.union(ties).select(
        "tie", "low", F.lit(-1).alias("high"), F.col("low").alias("block"), "doc", F.col("doc").alias("component"))


def _group_cells(lists: DataFrame) -> DataFrame:
    """Cells in which every two documents of a long list meet, if it has several components.

    Lists with the same smallest document hold much the same documents, so they
    are one group; a large one goes into blocks, each of which meets each other.
    """
    entries = lists.select("key", "doc", "n", "component")
    open_lists = entries.groupBy("key").agg(
        F.min("doc").alias("tie"), F.min("component").alias("least"), F.max("component").alias("most")).where(
        "least < most").select("key", "tie")
    groups = materialize(entries.join(open_lists, "key").select("tie", "doc", "n", "component").distinct(), "groups")
    sized = groups.groupBy("tie").agg(_blocks(F.count(F.lit(1)), F.sum("n")))
    dealt = groups.join(sized, "tie").select(
        "tie", "doc", "component", _block("doc").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("tie", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                        "block", "doc", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    short: int = 8) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Empty sets link with nothing, and rows without an id with nothing either
    (their component is null). Rows that share an id are judged each by its own
    text. A null text is an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = texts.where(F.col("doc_id").isNotNull())
    rows = materialize(documents_and_digests(texts), "sets")
    # One row per portion's digest is enough for the smallest id; a group of copies is combined before the shuffle.
    known = rows.where("digest is not null and doc_id is not null")
    several = known.groupBy("doc_id").agg((F.min("digest") < F.max("digest")).alias("several")).where("several")
    if not several.isEmpty():
        return _under_own_names(texts, rows, short)
    first = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "first")
    common = frequent(named)
    sizes = {r.n_shingles: r["count"] for r in known.where("n_shingles <= 100").groupBy(
        "n_shingles").count().collect()}  # at most 100 rows
    light = boundary(sizes, math.log2(2 + len(common)) / 4)
    buckets = _bucket_count(known, light, int(spark.conf.get("spark.sql.shuffle.partitions")))
    postings = _postings(named, common, light, buckets, short).repartitionById(buckets, F.col("bucket"))
    found = materialize(_scan_lists(postings, short), "candidates")
    reps = materialize(known.join(first.drop("n"), "digest").where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")

    def as_reps(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(reps.toDF(side, "rep"), side, "left").withColumn(
                side, F.coalesce("rep", side)).drop("rep")
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    pairs = materialize(as_reps(found.where("b is not null").select("a", "b").distinct()), "pairs")
    lists = materialize(found.where("b is null").select("key", F.col("a").alias("doc"), "n").join(
        reps.toDF("doc", "rep"), "doc", "left").withColumn("doc", F.coalesce("rep", "doc")).drop("rep"), "lists")
    met = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(lists.select("doc"))
    sketches = materialize(_sets(named, met, True), "sketches")
    links = materialize(_links(named, _star_cells(pairs, first), sketches), "links")
    groups = materialize(components(links), "components")
    placed = lists.join(groups.toDF("doc", "component"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    more = materialize(_links(named, _group_cells(placed), sketches), "links")
    if not more.isEmpty():
        groups = materialize(components(links.union(more)), "components")
    return rows.join(first.drop("n"), "digest", "left").join(
        groups.toDF("rep", "component"), "rep", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(
            "component", "rep", "doc_id")).alias("component_id"))


def _under_own_names(texts: DataFrame, rows: DataFrame, short: int) -> DataFrame:
    """The same for ids that have several texts: rows get names of their own, ids come back at the end."""
    held = materialize(texts.where("doc_id is not null").withColumn("name", F.monotonically_increasing_id()), "texts")
    found = near_duplicates(held, "name", "text", short).withColumnRenamed("doc_id", "name")
    found = materialize(held.select("name", "doc_id").join(found, "name"), "named")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id")).union(
        rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, len(w) AS k, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, CASE WHEN k < 5 THEN concat(k, ' ', array_to_string(w, ' '))
  ELSE array_to_string(w[i:i + 4], ' ') END AS x FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.node = d.doc_id
"""
