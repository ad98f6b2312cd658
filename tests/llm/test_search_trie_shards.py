"""Lexical search, the prefix trie and shards against plain versions and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm import kd_shards, lexical, prefix_trie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, item long, TERM int, rank int"


def same_as_sql(df, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.select(names).collect()), key=key) == sorted(found.fetchall(), key=key)


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical.TERM, low)


def plain_search(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in rows:
            score = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    m = 25 + 75 * sum(c.values()) * n_docs // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_search_against_sql(spark):
    same_as_sql(lexical.search(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))),
                lexical.SQL, "documents", "benchmark")


@pytest.mark.parametrize("bound", [1, 1 << 16])
def test_search_of_odd_rows(spark, rows, monkeypatch, bound):
    """Terms at edges and next to each other, other scripts, ties, repeats, nulls, long texts in slices."""
    monkeypatch.setattr(lexical, "_SLICE", 64)
    rng = np.random.default_rng(4)
    pieces = ["é", "Éa", "a", "A1", "日本", " ", "b b", "-", "'", "\n", "_", "it's", "\U0001f642", " "]
    docs = [(i, "".join(rng.choice(pieces, int(rng.integers(0, 60))))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "a"), (73, "a"), (73, "a"), (None, "a b"), (74, "a " * 5000 + "b"), (75, "x" * 5000 + " b"), (76, "ab")]
    items = [(1, "a it's A"), (2, "é 日本"), (3, None), (4, ""), (5, "zz"), (None, "b1 b"), (6, "\U0001f642 a1"), (7, "a a a")]
    d = spark.createDataFrame([(*r, "en", 1, 1, 1) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted(rows(lexical.search(d, i.union(i), bound=bound)), key=repr)
    assert got == plain_search(docs, items)
    assert lexical.search(d.limit(0), i).collect() == [] and lexical.search(d, i.limit(0)).collect() == []


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "",
                                             hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def plain_trie(rows):
    convs = rebuilt(rows)
    members, ends = {}, {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(prefix_trie.WORD, k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest())
                   for k, m in members.items()), key=repr)


def test_trie_against_sql(spark):
    same_as_sql(prefix_trie.prefix_trie(spark.read.parquet(f"{SF}/conversations.parquet")), prefix_trie.SQL, "conversations")


@pytest.mark.parametrize("block_rows", [1, 2, 7, 1 << 14])
def test_trie_of_odd_rows(spark, rows, block_rows):
    """Copies, turnless conversations, nulls, ties, a long one; prefixes that span blocks of any size."""
    rng = np.random.default_rng(block_rows)
    turns = [(int(c), int(t) if rng.random() < 0.9 else None, str(rng.choice(["user", "bot"])), str(rng.choice(["hi", "a b c", "", "Hi\x0bx"])))
             for c in range(-25, 60) for t in range(int(rng.integers(0, 5)))]
    turns += [(c, 0, "user", "same for all") for c in range(100, 130)] + [(c, 1, "bot", "and on") for c in range(115, 130)]
    turns += [(200, i, None, f"turn {i}") for i in range(300)] + [(201, i, "", f"turn {i}") for i in range(250)]
    turns += [(None, 1, "user", "no conversation"), (300, 1, "user", None), (300, 1, "user", None), (300, 1, "bot", "w " * 20000)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, key string, depth int")
    got = sorted(rows(prefix_trie.prefix_trie(df, block_rows=block_rows)), key=repr)
    assert got == plain_trie(turns)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def test_extents_are_found_from_any_row():
    lcp = np.array([-1, 2, 0, 3, 3, 1, 0])
    table = prefix_trie.sparse_table(lcp)
    left, right = prefix_trie.extents(table, np.array([4, 4, 3, 0, 6]), np.array([3, 1, 0, 2, 1]))
    assert left.tolist() == [2, 2, 0, 0, 6] and right.tolist() == [4, 5, 6, 1, 6]


def whole(placed, docs, shards):
    """Every row once, sizes and checksums, slots without gaps; returns the bytes of the shards."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in placed) == want
    slots = {}
    for r in placed:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return [sum(r["size"] for r in placed if r.shard == s) for s in range(shards)]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_near_equal(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = whole(kd_shards.shard_documents(docs, shards).collect(), plain, shards)
    assert max(sizes) - min(sizes) <= 2 * max(len((t or "").encode()) for _, t in plain)


def test_shards_of_hot_and_odd_rows(spark):
    """One row repeated for a third of all, one text and one source for the rest; nulls, clashing names, no dimensions."""
    docs = [(7, "copy of one row " * 5)] * 400 + [(i, "one text " * 9) for i in range(400)] + [(None, None), (1, ""), (2, "long " * 3000)]
    df = spark.createDataFrame([(*d, "s", None, float("nan") if d[0] == 7 else 5.0, 1, 2, 3) for d in docs],
                               "doc_id long, text string, source string, lang string, n_chars double, size int, shard int, k int")
    for dims in (("source", "lang", "n_chars"), ("absent",), ("source", "size", "k")):
        sizes = whole(kd_shards.shard_documents(df, 4, dims).collect(), docs, 4)
        assert max(sizes) - min(sizes) <= 16000
    assert kd_shards.shard_documents(df.limit(0)).collect() == []
    rows = kd_shards.report(df).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_cells_are_boxes_of_metadata(spark):
    """With one source per eighth of the bytes the tree finds the sources."""
    docs = spark.createDataFrame([(i, "x" * 99, f"s{i % 8}") for i in range(800)], "doc_id long, text string, source string")
    placed = kd_shards.shard_documents(docs, keep=True)
    assert placed.groupBy("shard").agg(F.count_distinct("row.source").alias("n")).where("n > 1").count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_written_shards(spark, tmp_path, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("mine"))
    kd_shards.write_shards(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.select(docs.columns)) == rows(docs)
    assert back.select("shard_").distinct().count() == 4
