"""Ranked lexical search that reads term counts straight from the texts.

The terms of all items form one automaton (Aho-Corasick), each guarded by a
separator on both sides, so that only whole terms match. Tasks get it by
broadcast and run it over the whole texts; nothing is stored per document. A
first scan gives the counts over all documents, a second one the scores: what
the automaton puts out is a term, a term leads to its items, and a task keeps
the best documents of each item it has seen.

Items come in blocks of a bounded number of terms, so what is broadcast does
not grow with their number; more blocks are more scans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import gather, id_and_text, offsets

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GUARD = b"\n"
#: Bytes of terms as they are (A-Z in lower case), all others as the guard.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else _GUARD[0] for b in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode()))
_SLICE = 1 << 20


@dataclass
class Block:
    """Some items: their ids, the distinct terms, and each term's items with its number there."""

    item_ids: list
    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, counted: list[tuple[object, Counter]]) -> Block:
        terms = sorted({t for _, counts in counted for t in counts})
        place = {t: i for i, t in enumerate(terms)}
        rows = sorted((place[t], item, n) for item, (_, counts) in enumerate(counted) for t, n in counts.items())
        term, items, times = np.array(rows, np.int64).reshape(-1, 3).T
        return cls([i for i, _ in counted], [t.encode() for t in terms],
                   np.searchsorted(term, np.arange(len(terms) + 1)), items, times)


def item_blocks(items: DataFrame, bound: int = 1 << 16, id_col: str = "item_id",
                text_col: str = "text") -> Iterator[Block]:
    """Blocks of items with about `bound` terms (an item is never cut), one in memory at a time."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    held, size = [], 0
    for row in items.select(F.col(id_col).alias("item_id"), F.regexp_extract_all(low, F.lit(TERM), F.lit(0)).alias(
            "terms")).distinct().groupBy("item_id").agg(F.flatten(F.collect_list("terms")).alias("terms")).where(
            F.size("terms") > 0).toLocalIterator():
        counts = Counter(row.terms)
        if held and size + len(counts) > bound:
            yield Block.of(held)
            held, size = [], 0
        held.append((row.item_id, counts))
        size += len(counts)
    if held:
        yield Block.of(held)


class Machine:
    """The automaton of a list of terms."""

    def __init__(self, terms: list[bytes]):
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            self.found.add_word((_GUARD + term + _GUARD).decode("latin-1"), i)
        self.found.make_automaton()

    def scan(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms in guarded text, and where each ends. Long texts go in slices cut at guards."""
        ends, terms, start = [], [], 0
        while start < len(data) - 1:
            stop = len(data) - 1
            if stop - start > _SLICE:
                stop = data.rfind(_GUARD, start + 1, start + _SLICE)
                stop = data.find(_GUARD, start + _SLICE) if stop < 0 else stop
            pairs = np.fromiter(chain.from_iterable(self.found.iter(data[start:stop + 1].decode("latin-1"))), np.int64)
            ends.append(pairs[::2] + start)
            terms.append(pairs[1::2])
            start = stop
        return (np.concatenate(ends), np.concatenate(terms)) if ends else (np.zeros(0, np.int64),) * 2


@dataclass
class Portion:
    """Some documents: ids, lengths in terms, and how often which item term stands in which of them."""

    ids: np.ndarray
    named: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def portions(batches: Iterator[pa.RecordBatch], terms: list[bytes], most_bytes: int = _SLICE,
             most_docs: int = 512) -> Iterator[Portion]:
    """Every document of (id, text) batches, in portions of bounded size or one document."""
    machine = Machine(terms)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start = 0
        while start < len(ids):
            held, size = [], 0
            while start + len(held) < len(ids) and len(held) < most_docs and (not held or size < most_bytes):
                held.append(texts[start + len(held)].as_py().encode("utf-8", "surrogatepass"))
                size += len(held[-1])
            data = (_GUARD + _GUARD.join(held) + _GUARD).translate(_BYTES)
            edges = offsets([len(h) + 1 for h in held])
            guard = np.frombuffer(data, np.uint8) == _GUARD[0]
            begins = np.flatnonzero(guard[:-1] & ~guard[1:])
            ends, found = machine.scan(data)
            doc = np.searchsorted(edges, ends - 1, side="right") - 1
            keys, tf = np.unique(doc * max(1, len(terms)) + found, return_counts=True)
            own = ids.slice(start, len(held))
            yield Portion(own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False),
                          np.diff(np.searchsorted(begins, edges)), keys // max(1, len(terms)),
                          keys % max(1, len(terms)), tf.astype(np.int64))
            start += len(held)


def corpus_counts(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and each block term's number of documents."""
    terms = block.terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, with_terms, length = np.zeros(len(terms), np.int64), 0, 0
        for p in portions(batches, terms):
            df += np.bincount(p.term, minlength=len(terms))
            with_terms += int((p.lengths > 0).sum())
            length += int(p.lengths.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [with_terms, length]))], ["term", "n"])

    found = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 2, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()  # -1 and -2 are the last two places
    return int(df[-1]), int(df[-2]), df[:-2]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _scores(p: Portion, block: Block, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Documents by items, in exact 64-bit integers."""
    m = 25 + (75 * p.lengths * n_docs) // max(1, n_terms)
    part = weight[p.term] * ((1_000_000_000 * p.tf) // (1000 * p.tf + 8 * m[p.doc]))
    lens = block.starts[p.term + 1] - block.starts[p.term]
    items = gather(block.items, block.starts[p.term], lens)
    part = np.repeat(part, lens) * gather(block.times, block.starts[p.term], lens)
    place = np.repeat(p.doc, lens) * len(block.item_ids) + items
    size = len(p.ids) * len(block.item_ids)
    # Two halves, each of which a double holds exactly.
    high, low = (np.bincount(place, x, size).astype(np.int64) for x in (part >> 24, part & 0xFFFFFF))
    return ((high << 24) + low).reshape(len(p.ids), -1)


def best_documents(docs: DataFrame, block: Block, k: int = 10) -> DataFrame:
    """The k best documents of each item of a block: item (its place in the block), rank, doc_id, score."""
    n_docs, n_terms, df = corpus_counts(docs, block)
    weight, n_items = weights(n_docs, df), len(block.item_ids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        item, score, doc_id, named = none, none, none, none.astype(bool)
        least = np.zeros(n_items, np.int64)
        for p in portions(batches, block.terms):
            scores = _scores(p, block, weight, n_docs, n_terms)
            doc, new = np.nonzero((scores > 0) & (scores >= least))
            if not len(doc):
                continue
            item, score = np.append(item, new), np.append(score, scores[doc, new])
            doc_id, named = np.append(doc_id, p.ids[doc]), np.append(named, p.named[doc])
            order = np.lexsort((doc_id, ~named, -score, item))
            place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            full = order[place == k - 1]
            least[item[full]] = score[full]
            order = order[place < k]
            item, score, doc_id, named = item[order], score[order], doc_id[order], named[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc_id, mask=~named), pa.array(score)], ["item", "doc_id", "score"])

    found = docs.mapInArrow(search, "item long, doc_id long, score long")
    # First the winners of some tasks, then of all: no task gets the winners of every other one.
    for keys in (["item", "share"], ["item"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn(
            "rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, bound: int = 1 << 16, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item.

    Terms are runs of digits, letters and all characters from U+0080 on, A-Z in
    lower case. Whole texts are read. A null or empty text has no terms; such
    documents count nowhere, such items have no rows. Only scores above 0 are
    returned; ties go to the smaller id, a null id comes last. Rows repeated in
    documents are documents of their own; of repeated items one stays, and
    texts that share an item id are one item. Empty tables give no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").withColumn(
        "item_id", F.col("item_id").cast(kind))
    for block in item_blocks(items, bound, item_col, item_text_col):
        ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.item_ids)), pa.int64()), "item_id": block.item_ids}))
        out = out.union(best_documents(rows, block, k).join(F.broadcast(ids), "item").select(
            F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, n_docs),
x AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))) AS part
  FROM p JOIN f USING (t), c),
s AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM x JOIN i USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
