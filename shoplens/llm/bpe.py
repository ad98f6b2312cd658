"""Byte-level BPE by merge replay over the distinct pieces of a block of texts.

The texts of a block are cut into pieces by the vocabulary's pattern. All
distinct pieces lie in one array of symbols with links to their neighbours. An
inverted index leads from a merge rank to the positions where its pair stands;
ranks are taken in order, every occurrence in the block is merged at once, and
only the touched neighbours get new pairs in the index.

Blocks are worked on by Spark tasks next to the text, so no text is shuffled;
the ids of a piece do not depend on the block it is in.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.chunks import ChunkEncoder, cut_before_words, portions, text_of
from shoplens.llm.common import gather, id_and_text, offsets, worker_cache

_NONE = np.int64(1) << 40


class MergeTable:
    """Ranks of a vocabulary file, as arrays: pairs of ids to the rank of their union."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b)
                          for a, b in (line.split() for line in lines if line.strip())}
        self.size = max(self.ranks.values()) + 1
        by_id = [b""] * self.size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.lens = np.array([len(t) for t in by_id], np.int64)
        self.starts = offsets(self.lens)[:-1]
        keys, ranks, find = [], [], self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = find(token[:i]), find(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62)
        self.pair_ranks = np.append(np.array(ranks, np.int64)[order], _NONE)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.pair_ranks[at], _NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        return gather(self.flat, self.starts[ids], self.lens[ids])

    def one_by_one(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the lowest rank, the leftmost of equal ones."""
        parts = [self.ranks[bytes([b])] for b in piece]
        while len(parts) > 1:
            ranks = self.rank(np.array(parts[:-1]), np.array(parts[1:]))
            i = int(ranks.argmin())
            if ranks[i] == _NONE:
                break
            parts[i:i + 2] = [int(ranks[i])]
        return parts


def replay(pieces: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in order and the number of each piece's ids.

    A piece that is a token is that token. A merge whose new pair ranks below
    the merge itself would have to come before the piece's later merges of the
    same rank; such pieces (none in ordinary vocabularies) are redone one by one.
    """
    n = len(pieces)
    whole = np.fromiter((table.ranks.get(p, -1) for p in pieces), np.int64, n)
    todo = np.flatnonzero(whole < 0)
    words = [pieces[i] for i in todo]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    symbol = table.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    size = len(symbol)
    word = np.repeat(np.arange(len(words)), lens)
    at = offsets(lens)
    after = np.arange(1, size + 1)
    after[at[1:][lens > 0] - 1] = size
    before = np.arange(-1, size)  # one more place than symbols: writes past the end go there
    before[at[:-1][lens > 0]] = -1
    dead = np.zeros(size, bool)
    pair = np.full(size + 1, _NONE)
    left = np.flatnonzero(after < size)
    pair[left] = table.rank(symbol[left], symbol[left + 1])
    odd: set[int] = set()

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(positions: np.ndarray) -> None:
        ranks = pair[positions]
        keep = ranks < _NONE
        positions, ranks = positions[keep], ranks[keep]
        if not len(positions):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, group in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
            if rank in index:
                index[rank].append(group)
            else:
                index[rank] = [group]
                heapq.heappush(heap, rank)

    note(left)
    while heap:
        rank = heapq.heappop(heap)
        groups = index.pop(rank)
        p = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        p = p[pair[p] == rank]
        if not len(p):
            continue
        if len(p) > 1:  # a run of overlapping pairs: the first, the third, ...
            chained = np.append(False, after[p[:-1]] == p[1:])
            if chained.any():
                place = np.arange(len(p))
                place -= np.maximum.accumulate(np.where(chained, 0, place))
                p = p[place % 2 == 0]
        q = after[p]
        s = after[q]
        symbol[p] = rank
        after[p] = s
        before[s] = p
        dead[q] = True
        pair[q] = _NONE
        inner = s < size
        pair[p] = _NONE
        pair[p[inner]] = table.rank(symbol[p[inner]], symbol[s[inner]])
        o = before[p]
        touched = o >= 0
        o, right = o[touched], p[touched]
        pair[o] = table.rank(symbol[o], symbol[right])
        changed = np.unique(np.concatenate([p, o]))
        early = changed[pair[changed] < rank]
        if len(early):
            odd.update(word[early].tolist())
        note(changed)

    alive = ~dead
    counts = np.bincount(word[alive], minlength=len(words)) if size else np.zeros(len(words), np.int64)
    ids = symbol[alive]
    if odd:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w in odd:
            parts[w] = np.array(table.one_by_one(words[w]), np.int64)
        ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
    out_lens = np.ones(n, np.int64)
    out_lens[todo] = counts
    out = np.empty(int(out_lens.sum()), np.int64)
    merged = np.repeat(whole < 0, out_lens)
    out[merged] = ids
    out[~merged] = whole[whole >= 0]
    return out, out_lens


def encoder(path: str, pattern: str, bound: int = 500_000) -> tuple[ChunkEncoder, MergeTable]:
    """The encoder of this worker for a vocabulary file and a split pattern."""
    cache = worker_cache("bpe")
    key = ("bpe", path, pattern, bound)
    if key not in cache:
        import regex
        table, find = MergeTable(path), regex.compile(pattern).findall

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            cut = [find(text_of(c)) for c in chunks]
            distinct = list(set().union(*cut))
            place = {p: i for i, p in enumerate(distinct)}
            ids, lens = replay([p.encode("utf-8", "surrogatepass") for p in distinct], table)
            at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64)
            flat = gather(ids, offsets(lens)[:-1][at], lens[at])
            per_piece = offsets(lens[at])
            return flat, np.diff(per_piece[offsets([len(x) for x in cut])])

        cache[key] = (ChunkEncoder(cut_before_words, encode, bound), table)
    return cache[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Digests of each text's ids and of the bytes the ids decode to.

    A null text counts as empty: no ids, both digests of nothing. Repeated rows
    give repeated results, an empty table an empty one; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(path, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in portions(texts):
                ids, at = encode.encode_texts(texts[start:stop])
                data = table.decode(ids)
                places = offsets(table.lens[ids])[at]
                raw = ids.astype("<u4").tobytes()
                data = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(start, stop - start),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest()
                              for a, b in zip(at[:-1], at[1:])], pa.string()),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest()
                              for a, b in zip(places[:-1], places[1:])], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in portions(texts):
                ids, at = encode.encode_texts(texts[start:stop])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                ], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of each row's ids; null ids give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = encoder(path, pattern)
        for batch in batches:
            rows = [table.decode(np.array(x or [], np.int64)).tobytes()
                    for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id long, data binary")
