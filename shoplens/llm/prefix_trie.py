"""The trie of the prefixes of conversations, by sorted neighbours.

Conversations are sorted by the digests of their turns, so those that share a
prefix stand side by side. In a block of neighbours a sparse table holds the
minima of the common prefix lengths (LCPs) over all stretches of 1, 2, 4, ...
rows. Every candidate prefix finds its member interval by two binary searches
in that table, to the left and to the right, independently of all others; the
same kind of table gives the smallest member.

A block is a bounded stretch of the sorted rows. A prefix inside a block is
complete there. One of the first or last row may go on in the next block: such
open prefixes, at most one path for each side of a block, are met by Spark
afterwards by the digest of the whole prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import gather, offsets
from shoplens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
_WIDTH = 16
_FIRST, _LAST = 1, 2
NODES = ("block long, side int, depth int, digest binary, conv_id long, parent_side int, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string")


def rebuilt(turns: DataFrame, head: Column, donor: Column, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text", longest: int = 3) -> DataFrame:
    """conv_id, key (digests of all turns, joined) and words (of each turn) of rebuilt conversations.

    The first `head` turns (at most `longest`) come from the conversation
    `donor`, the rest are the conversation's own turns after its first `head`.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(
        F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, _WIDTH)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("text"),
                 digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words"))).alias("turns"))
    whole = materialize(whole, "turns")
    givers = whole.select(F.col("conv_id").alias("donor"), F.slice("turns", 1, longest).alias("lead"))
    own = F.slice("turns", F.col("head") + 1, F.size("turns"))
    made = whole.withColumn("head", head).withColumn("donor", donor).join(givers, "donor", "left").select(
        "conv_id", F.concat(F.coalesce(F.when(F.col("head") > 0, F.slice("lead", 1, F.col("head"))),
                                       F.array().cast("array<struct<digest:binary,words:int>>")), own).alias("turns"))
    key = F.coalesce(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), ""), F.lit(""))
    return made.select("conv_id", F.unhex(key).alias("key"), F.transform("turns", lambda t: t.words).alias("words"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level j holds the minimum of values[i:i + 2**j] at place i."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def minimum(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low:high + 1], from two stretches that overlap."""
    level = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), table[0].dtype)
    for j in np.unique(level):
        at = np.flatnonzero(level == j)
        out[at] = np.minimum(table[j][low[at]], table[j][high[at] - (1 << j) + 1])
    return out


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share their first `depth` turns with `row`.

    table: of the LCP of each row with the row before it. Either end moves by
    halving steps as long as the minimum of the LCPs on the way is large enough.
    """
    left, right, n = row.copy(), row.copy(), len(table[0])
    for j in reversed(range(len(table))):
        step, level = 1 << j, table[j]
        able = right + step < n
        able[able] = level[right[able] + 1] >= depth[able]
        right[able] += step
        able = left - step >= 0
        able[able] = level[left[able] - step + 1] >= depth[able]
        left[able] -= step
    return left, right


def _common(keys: list[bytes]) -> np.ndarray:
    """LCP in turns of each key with the one before it; -1 for the first."""
    out = np.full(len(keys), -1, np.int64)
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out[i] = n // _WIDTH
        else:
            x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
            out[i] = int((x != y).argmax()) // _WIDTH
    return out


def _path(key: bytes) -> list[bytes]:
    """Digests of all prefixes of a key, the empty one first."""
    running, out = hashlib.sha256(), []
    for at in range(0, len(key) + _WIDTH, _WIDTH):
        out.append(running.copy().digest()[:_WIDTH])
        running.update(key[at:at + _WIDTH])
    return out


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def block_nodes(block: int, conv_ids: np.ndarray, keys: list[bytes], words: list[np.ndarray]) -> pa.RecordBatch:
    """All prefixes of a stretch of sorted rows.

    side 0: complete. The ends are a digest; the parent's smallest member is
    given, or the side on which the parent is open. _FIRST and _LAST: open on
    the path of the first or last row, with what this block has of the prefix:
    its members, complete children, and sums over the complete nodes below; the
    ends as text. Where both paths agree the one of the last row counts nothing.
    """
    n = len(keys)
    lens = np.array([len(k) // _WIDTH for k in keys], np.int64)
    lcp = _common(keys)
    table = sparse_table(lcp)
    # Candidates: each row's prefixes that the row before it does not have.
    new = lens - lcp
    row = np.repeat(np.arange(n), new)
    at = offsets(new)
    depth = np.arange(at[-1]) - np.repeat(at[:-1] - lcp - 1, new)
    left, right = extents(table, row, depth)
    size = right - left + 1
    smallest = minimum(sparse_table(conv_ids), left, right)
    flat, word_at = np.concatenate([*words, np.zeros(0, np.int64)]), offsets(lens)
    value = np.where(depth > 0, flat[np.maximum(word_at[row] + depth - 1, 0)] if len(flat) else 0, 0)
    # Rows that end at a prefix stand first in its interval; the row of each ending finds its node to the left.
    first, _ = extents(table, np.arange(n), lens)
    ending = np.bincount(at[first] + lens - lcp[first] - 1, minlength=len(row))
    is_open = (left == 0) | (right == n - 1)
    # A parent is the next shorter prefix: its first row is found to the left, its place from there.
    above, _ = extents(table, row, np.maximum(depth - 1, 0))
    parent = np.where(depth > 0, at[above] + depth - lcp[above] - 2, -1)
    closed_child = ~is_open & (parent >= 0)
    children = np.bincount(parent[closed_child], minlength=len(row))
    leaf = ~is_open & (children == 0)
    # Candidates are in preorder: all below a prefix follow it, up to the last of its last row.
    below = at[right + 1]
    own = np.arange(len(row))
    saved_sums = offsets(np.where(is_open, 0, (size - 1) * value))
    leaf_sums = offsets(leaf)
    saved, leaves = saved_sums[below] - saved_sums[own], leaf_sums[below] - leaf_sums[own]
    paths = {_FIRST: _path(keys[0]), _LAST: _path(keys[-1])}
    on_first, on_last = left == 0, right == n - 1
    open_parent = is_open[parent] & (parent >= 0)
    parent_side = np.where(open_parent, np.where(on_first[parent], _FIRST, _LAST), 0)
    side = np.where(is_open, np.where(on_first, _FIRST, _LAST), 0)
    ends = [",".join(map(str, ids)) if o else _sha(ids) for o, ids in (
        (o, conv_ids[a:a + e]) for o, a, e in zip(is_open, left, ending))]
    columns = [np.full(len(row), block), side, depth, [paths[s][d] if s else None for s, d in zip(side.tolist(), depth.tolist())],
               smallest, parent_side, pa.array(smallest[parent], mask=open_parent | (parent < 0)), size, children,
               leaves, saved, value, ends]
    # The common part of both paths once more, for the path of the last row.
    both = np.flatnonzero(on_first & on_last)
    again = [np.full(len(both), block), np.full(len(both), _LAST), depth[both], [paths[_LAST][d] for d in depth[both].tolist()],
             smallest[both], np.zeros(len(both), int), pa.nulls(len(both), pa.int64())] + [np.zeros(len(both), int)] * 4 + [
                 value[both], [""] * len(both)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
    names = [c.split()[0] for c in NODES.split(", ")]
    arrays = [pa.concat_arrays([pa.array(x).cast(k) if not isinstance(x, list) else pa.array(x, k) for x in pair])
              for pair, k in zip(zip(columns, again), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _blocks(conversations: DataFrame, block_rows: int, block_turns: int) -> DataFrame:
    """The nodes of all blocks. A block is at most so many rows, or turns, of a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, keys, words, turns = [], [], [], 0
        for batch in batches:
            for conv_id, key, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words"))):
                if ids and (len(ids) >= block_rows or turns + len(own) > block_turns):
                    yield block_nodes(block, np.array(ids, np.int64), keys, words)
                    block += 1
                    ids, keys, words, turns = [], [], [], 0
                ids.append(conv_id)
                keys.append(key)
                words.append(np.array(own, np.int64))
                turns += len(own)
        if ids:
            yield block_nodes(block, np.array(ids, np.int64), keys, words)

    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = conversations.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return ordered.mapInArrow(run, NODES)


def _digests_of_ends(pieces: DataFrame) -> DataFrame:
    """digest and ends_sha256 of open prefixes; the pieces of one follow each other and are hashed as they pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done = []
            for digest, ends in zip(batch.column(0), batch.column(1)):
                digest, ends = digest.as_py(), ends.as_py().encode()
                if digest == now:
                    running.update(b"," + ends)
                    continue
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running = digest, hashlib.sha256(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())],
                ["digest", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.binary()), pa.array([running.hexdigest()])], ["digest", "ends_sha256"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where("ends <> ''").select("digest", "ends", "block").repartition(n, "digest").sortWithinPartitions(
        "digest", "block").select("digest", "ends")
    return dealt.mapInArrow(run, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, block_rows: int = 1 << 14, block_turns: int = 1 << 18) -> DataFrame:
    """One row per distinct prefix of (conv_id, key, words) rows, the empty one included.

    Returns conv_id (smallest member), depth, parent_conv_id (of the root: null),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Prefixes are told
    apart by 128-bit digests of their turns. A conversation is one row: 16 bytes
    and a number per turn. No conversations give no nodes.
    """
    nodes = materialize(_blocks(conversations, block_rows, block_turns), "nodes")
    # The open ones: at most two paths per block.
    opened = materialize(nodes.where("side > 0"), "open")
    place = F.struct("block", "side")
    merged = opened.groupBy("digest").agg(
        F.min(place).alias("owner"), F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"))
    path = Window.partitionBy("block", "side").orderBy("depth")
    paths = opened.join(merged, "digest").withColumn("owned", (F.col("owner") == place).cast("long"))
    paths = paths.select("*", F.coalesce(F.lead("owned").over(path), F.lit(0)).alias("new_child"),
                         F.lag("least").over(path).alias("parent_least"))
    paths = materialize(paths, "paths")
    kids = paths.groupBy("digest").agg(F.sum(F.col("n_children") + F.col("new_child")).alias("kids"))
    under = Window.partitionBy("block", "side").orderBy(F.desc("depth"))
    summed = paths.join(kids, "digest").select(
        "*", F.sum((F.col("owned") * (F.col("kids") == 0).cast("long"))).over(under).alias("more_leaves"),
        F.sum(F.col("owned") * (F.col("members") - 1) * F.col("words")).over(under).alias("more_saved"))
    found = summed.groupBy("digest").agg(
        F.min("least").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_least").alias("parent_conv_id"),
        F.min("members").alias("n_convs"), F.min("kids").alias("n_children"),
        F.sum(F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_nodes = found.join(_digests_of_ends(opened), "digest", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).select(columns)
    # Complete nodes below an open one get its smallest member, block by block.
    inner = nodes.where("side = 0").withColumnRenamed("ends", "ends_sha256")
    known = inner.where("parent_side = 0").select(columns)
    asking = inner.where("parent_side > 0").drop("parent_conv_id", "side")
    answers = paths.select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"),
                           F.col("least").alias("parent_conv_id"))
    asking = asking.join(answers, ["block", "parent_side", "depth"]).select(columns)
    return open_nodes.union(known).union(asking).withColumn("depth", F.col("depth").cast("long"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", block_rows: int = 1 << 14) -> DataFrame:
    """The trie of conversations rebuilt on shared heads.

    Turns are ordered by turn (null first), ties by role and the text's SHA-256;
    a null role or text is empty, texts are read whole; rows repeated whole are turns of their own. Conversation c
    takes its first crc32(c) % 4 turns from conversation c - c % 20, if that
    exists. Rows without conversation id belong to none and are left out. Other
    columns are not read; an empty table gives no nodes.
    """
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")
    return trie(rebuilt(turns, head, c - c % 20, conv_col, turn_col, role_col, text_col), block_rows)


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, {'k': md5(length(role) || ':' || role || text),
  'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM t),
a AS (SELECT conv_id, list(t ORDER BY i) AS l FROM o GROUP BY conv_id),
b AS (SELECT *, list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda v, x: CASE WHEN x >= 0 THEN xor(v, x)
  WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM a),
h AS (SELECT a.conv_id, xor(a.v, 4294967295) % 4 AS h, a.l, d.l AS g FROM b a LEFT JOIN a d ON d.conv_id = a.conv_id - a.conv_id % 20),
r AS (SELECT conv_id, coalesce(g[1:h], []) || l[h + 1:] AS l FROM h),
p AS (SELECT conv_id, len(l) AS n, d AS depth, list_transform(l[1:d], lambda x: x.k) AS k,
  CASE WHEN d > 0 THEN l[d].w ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(
  conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM p GROUP BY k, depth),
c AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.k = n.k),
s AS (SELECT k[1:d] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN n q ON m.depth > 0 AND q.k = m.k[1:m.depth - 1]
"""
