import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoplens.operators import neighbors as nb
from shoplens.operators.neighbors import grouped_knn, knn_join, lsh_candidates
from shoplens.operators.vectors import embed_texts, vector_topk

DIM = 8


def table(spark, name, rows):
    return spark.createDataFrame([(f"{i:04d}", [float(x) for x in r]) for i, r in enumerate(rows)],
                                 f"{name} string, vector array<float>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    # Small integers make many equal scores, so ties are exercised too.
    index, queries = rng.integers(-2, 3, (400, DIM)), rng.integers(-2, 3, (60, DIM))
    index[::3] = index[0]
    return index, queries, table(spark, "key", index), table(spark, "query_id", queries)


def brute(index, queries, k):
    def unit(m):
        m = m.astype("float64")
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)
    scores = np.round(unit(queries) @ unit(index).T, 6) + 0.0
    out = set()
    for q, row in enumerate(scores):
        best = sorted((-s, f"{i:04d}") for i, s in enumerate(row))[:k]
        out |= {(f"{q:04d}", key, round(-s + 0.0, 6), r) for r, (s, key) in enumerate(best, 1)}
    return out


def found(df):
    return {(r.query_id, r.key, round(r.score, 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 7, 500])
@pytest.mark.parametrize("rows", [1 << 16, 37, 5])
def test_exact_with_slots_of_any_size(data, k, rows):
    index, queries, left, right = data
    want = brute(index, queries, k)
    assert found(knn_join(left, right, k, DIM, slot_bytes=8 * DIM * rows, pivots=6)) == want


def clusters(n=4000, groups=100, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return centres[np.arange(n) % groups] + 0.08 * rng.standard_normal((n, dim))


def test_pivots_skip_rings_and_blocks(spark):
    """Exact, and most rings, and most blocks of a visited slot, are never compared."""
    rows = clusters()
    left, right = table(spark, "key", rows), table(spark, "query_id", rows[:200])
    got = found(knn_join(left, right, 3, 16, slot_bytes=8 * 16 * 50))
    assert got == brute(rows, rows[:200], 3)
    placed, rings = nb.ring_index(left, 16, 8 * 16 * 50)
    asked = right.withColumn("least", F.lit(0.97))
    planned = nb.visits(asked, rings, 3, 16, True).union(nb.visits(right, rings, 3, 16, False)).count()
    assert planned < 0.2 * 200 * len(rings.n)
    units = nb.unit_rows(rows)
    away = np.sqrt(np.maximum(0, 2 - 2 * units @ units[0]))
    slot = nb.Slot(np.array([f"{i:04d}" for i in range(len(rows))]), units, away)
    slot.search(["0000"], units[:1], away[:1], np.array([-np.inf]), 3)
    assert slot.skipped > 4 * slot.scored


def test_search_plan_has_no_driver_fetch(data):
    _, _, left, right = data
    import inspect
    assert "toPandas" not in inspect.getsource(nb)
    plan = knn_join(left, right, 3, DIM, slot_bytes=999)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rows_that_cannot_be_compared(spark):
    """Another length, null, null or infinite components: left out on both sides. Zeros score 0."""
    good = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])]
    odd = [("c", [1.0]), ("d", None), ("e", [None, 1.0]), ("f", [float("inf"), 1.0]), ("g", [])]
    index = spark.createDataFrame(good + odd, "key string, vector array<float>")
    asked = index.withColumnRenamed("key", "query_id")
    for rows in (99, 1):
        got = found(knn_join(index, asked, 2, 2, slot_bytes=16 * rows))
        assert got == {("a", "a", 1.0, 1), ("a", "b", 0.0, 2), ("b", "b", 1.0, 1), ("b", "a", 0.0, 2),
                       ("z", "a", 0.0, 1), ("z", "b", 0.0, 2)}
    assert knn_join(index.filter("key = 'd'"), asked, 2, 2).collect() == []
    assert knn_join(index, asked.limit(0), 2, 2).collect() == []


def test_single_query(data):
    index, queries, left, _ = data
    rows = left.withColumn("metadata", F.create_map(F.lit("k"), F.col("key")))
    got = vector_topk(rows, [float(x) for x in queries[0]], 9).collect()
    want = sorted((r[3], r[1], r[2]) for r in brute(index, queries[:1], 9))
    assert [(i, r.key, round(r.score, 6)) for i, r in enumerate(got, 1)] == want


def test_grouped_stays_in_group(spark, data):
    index, queries, left, right = data
    # Two thirds of the index lie in one group, which needs several blocks.
    hot = (F.col("key").cast("int") % 3 > 0).cast("string")
    got = grouped_knn(left.withColumn("bucket", hot), right.withColumn("bucket", F.lit("true")),
                      5, DIM, slot_bytes=8 * DIM * 50).collect()
    keep = [i for i in range(len(index)) if i % 3 > 0]
    want = {(q, f"{keep[int(key)]:04d}", s, r) for q, key, s, r in brute(index[keep], queries, 5)}
    assert {(r.query_id, r.key, round(r.score, 6), r["rank"]) for r in got} == want


def test_lsh_recall_on_clusters(spark):
    """Recall at least 0.9 for less than 5 % of all pairs, itself left out; scores are exact."""
    rows = clusters()
    left, right = table(spark, "key", rows), table(spark, "query_id", rows[:400])
    want = {(q, k): s for q, k, s, _ in brute(rows, rows[:400], 6) if q != k}
    near = found(lsh_candidates(left, right, 5, 16))
    assert all(q != k for q, k, *_ in near)
    hit = [(q, k) for q, k, s, _ in near if (q, k) in want]
    assert len(hit) >= 0.9 * 400 * 5 and all(abs(want[q, k] - s) < 2e-6 for q, k, s, _ in near if (q, k) in want)
    signs = nb.Probes(nb.lsh_planes(nb.lsh_bits(4000), 16))
    probes = nb.tuned_probes(left, right, 5, 16, signs, 0.95, 200)
    stored, asked = nb.lsh_buckets(left, right, 16, signs, probes)
    assert stored.count() == 4000       # one signature a row
    assert stored.join(asked, "bucket").count() < 0.05 * 4000 * 400


def test_lsh_recall_on_the_given_vectors(spark):
    """Vectors without structure need most of the buckets; the recall is kept all the same."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr(
        "cast(vec_id as string) key", "embedding vector")
    asked = rows.withColumnRenamed("key", "query_id")
    want = {(q, k) for q, k, *_ in found(knn_join(rows, asked, 6, 64)) if q != k}
    near = {(q, k) for q, k, *_ in found(lsh_candidates(rows, asked, 5, 64))}
    assert len(near & want) >= 0.9 * 500 * 5


def test_probes_in_order_of_cost():
    """All buckets once each, cheapest first; more signs than flips leave some unreachable."""
    rng = np.random.default_rng(2)
    for bits in (5, 20):
        signs = nb.Probes(rng.standard_normal((bits, 8)))
        margins = signs.margins(rng.standard_normal((4, 8)))
        first = signs.buckets(margins, 1)[:, 0]
        assert first.tolist() == signs.codes(margins).tolist()
        every = signs.buckets(margins, 1 << nb.FLIPS)
        assert all(len(set(r)) == 1 << signs.flips for r in every.tolist())
        assert signs.ranks(margins, signs.codes(margins)).tolist() == [0] * 4
        assert all(r < 1 << nb.FLIPS for r in signs.ranks(margins, every[:, 7]))
    assert signs.ranks(margins, signs.codes(margins) ^ ((1 << 20) - 1)).tolist() == [1 << nb.FLIPS] * 4


def test_embed_counts_each_text_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def embedder(texts, dimensions):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return np.array([[len(t)] * dimensions for t in texts])

    df = spark.createDataFrame([(1, "Red  Kite"), (2, "red kite "), (3, None), (4, "x")],
                               "i int, t string")
    got = {r.i: r.vector for r in embed_texts(df, "t", 2, embedder).collect()}
    assert got == {1: [8, 8], 2: [8, 8], 3: [0, 0], 4: [1, 1]}
    assert sorted(open(log).read().split("\n")) == ["", "", "red kite", "x"]
    plain = {r.i: r.vector for r in embed_texts(df, "t", 2, embedder, distinct=False).collect()}
    assert plain == got


def test_hashed_embedding_is_unit(spark):
    df = spark.createDataFrame([("a b b",), ("",)], "t string")
    got = [np.linalg.norm(r.vector) for r in embed_texts(df, "t", 16).orderBy("t").collect()]
    assert got == pytest.approx([0.0, 1.0])


def test_visits_leave_in_bounded_batches():
    """A query that visits very many places is not expanded in one batch."""
    batch = pa.RecordBatch.from_pydict({"query_id": ["a", "b"], "vector": [[1.0, 0.0], [0.0, 1.0]]})
    rows = np.repeat([0, 1], 3 * nb.BATCH_ROWS // 2 + 1)
    parts = list(nb._repeated(batch, rows, bucket=np.arange(len(rows))))
    assert max(p.num_rows for p in parts) <= nb.BATCH_ROWS
    assert np.concatenate([p.column("bucket") for p in parts]).tolist() == list(range(len(rows)))
    assert sum(p.column("query_id").to_pylist().count("a") for p in parts) == len(rows) // 2


def test_queries_go_to_groups_of_buckets(spark):
    """Probing most of 128 buckets takes a query to the few slots of the index, not to every bucket."""
    rows = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(
        np.random.default_rng(3).standard_normal((1024, 16)))], "key string, vector array<float>")
    asked = rows.withColumnRenamed("key", "query_id").limit(50)
    signs = nb.Probes(nb.lsh_planes(nb.lsh_bits(1024), 16))
    stored, sent = nb.lsh_groups(rows, asked, 16, signs, 90, 1024, slot_bytes=8 * 16 * 256)
    assert stored.count() == 1024 and stored.select("bucket").distinct().count() == 4
    assert sent.count() <= 50 * 4
    assert nb.lsh_buckets(rows, asked, 16, signs, 90)[1].count() == 50 * 90


def near_by_hashing(rows, asked, k, planes, probes, keys=None, ids=None):
    """Plain: of each query, the best rows in the buckets whose rank by cost, over all signs, is below `probes`."""
    keys, ids = keys or [f"{i:04d}" for i in range(len(rows))], ids or [f"{i:04d}" for i in range(len(asked))]
    units, wanted = nb.unit_rows(np.float64(np.float32(rows))), nb.unit_rows(np.float64(np.float32(asked)))
    bits = len(planes)
    codes = (units @ planes.T >= 0) @ (1 << np.arange(bits))
    every = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    out = {}
    for query, unit in zip(ids, wanted):
        margins = planes @ unit
        costs = every @ margins ** 2
        limit = np.sort(costs)[min(probes, len(costs)) - 1]
        own = (margins >= 0) @ (1 << np.arange(bits))
        scores = np.round(units @ unit, 6) + 0.0
        out.setdefault(query, []).extend((-s, key) for s, key, c in zip(scores, keys, costs[codes ^ own])
                                         if key is not None and key != query and c <= limit + 1e-12)
    return sorted((q, key, -s + 0.0, r) for q, found in out.items() if q is not None
                  for r, (s, key) in enumerate(sorted(found)[:k], 1))


def as_listed(df):
    return sorted((r.query_id, r.key, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("probes", [1, 700, 6000, 1 << 14])
def test_lsh_probes_over_all_signs(spark, probes):
    """More signs than FLIPS: buckets are probed by cost over all of them, none is out of reach."""
    rows = np.random.default_rng(9).standard_normal((900, DIM))
    rows[::7] = rows[0]     # one common vector: ties go to the smaller key
    planes = nb.lsh_planes(14, DIM)
    want = near_by_hashing(rows, rows[:150], 4, planes, probes)
    left, right = table(spark, "key", rows), table(spark, "query_id", rows[:150])
    for slot_bytes in (nb.ASKED_BYTES, 8 * DIM * 40):
        assert as_listed(lsh_candidates(left, right, 4, DIM, bits=14, probes=probes, slot_bytes=slot_bytes)) == want


def test_limits_and_order_of_all_buckets():
    rng = np.random.default_rng(4)
    for bits in (1, 5, 13):
        signs = nb.Probes(rng.standard_normal((bits, DIM)))
        margins = signs.margins(nb.unit_rows(rng.standard_normal((6, DIM))))
        every = ((np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1) @ (margins ** 2).T
        for probes in {1, 2, (1 << bits) // 3 + 1, 1 << bits}:
            assert ((every <= signs.limits(margins, probes)).sum(axis=0) == probes).all()
        codes = rng.integers(0, 1 << bits, 6)
        own = [every[c, i] for i, c in enumerate(codes ^ signs.codes(margins))]
        assert signs.below(margins, codes).tolist() == (every < np.array(own) - 1e-12).sum(axis=0).tolist()
    assert signs.limits(np.zeros((1, 13)), 5) >= 0 and signs.below(np.zeros((1, 13)), np.array([77])).tolist() == [0]


def test_few_rows_are_looked_at_closely():
    """Where nearly all buckets are probed, buckets and exact scores are found for few of the pairs."""
    rows = np.random.default_rng(6).standard_normal((6000, DIM))
    units, names = nb.unit_rows(rows), np.array([f"{i:04d}" for i in range(6000)], object)
    signs = nb.Probes(nb.lsh_planes(9, DIM))
    asked = nb.Asked(signs, 3, names[:300], units[:300], signs.limits(signs.margins(units[:300]), 400))
    codes = signs.codes(signs.margins(units)).astype(float)
    for at in range(0, 6000, 1001):
        part = slice(at, at + 1001)
        asked.add(pa.array(names[part].tolist()), names[part], units[part], codes[part])
    got = sorted((r["query_id"], r["key"], round(r["score"], 6)) for r in asked.found().to_pylist())
    want = near_by_hashing(rows, rows[:300], 3, signs.planes, 400, ids=list(names[:300]))
    assert [(q, s) for q, _, s in got] == [(q, pytest.approx(s, abs=2e-6)) for q, _, s, _ in sorted(want, key=lambda r: r[:2])]
    assert asked.close < 0.03 * 6000 * 300


def test_queries_travel_once_where_all_buckets_count(spark):
    """Vectors without structure are not grouped: a query goes to no more places than there are stretches of rows."""
    rng = np.random.default_rng(2)
    loose = nb.unit_rows(rng.standard_normal((64, 16)))
    signs = nb.Probes(nb.lsh_planes(13, 16))
    assert nb.best_prefix(signs, 5000, loose, 100_000) == 0 < nb.best_prefix(signs, 1, loose, 100_000)
    assert nb.best_prefix(signs, 5000, loose[:0], 0) == 0


def test_lsh_with_repeated_and_missing_keys(spark):
    rows = np.random.default_rng(7).integers(-2, 3, (60, DIM)) + 0.25
    keys = [None if i % 11 == 0 else f"{i % 40:04d}" for i in range(60)]
    left = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in zip(keys, rows)], "key string, vector array<float>")
    want = near_by_hashing(rows, rows, 4, nb.lsh_planes(4, DIM), 9, keys, keys)
    assert as_listed(lsh_candidates(left, left.withColumnRenamed("key", "query_id"), 4, DIM, bits=4, probes=9)) == want
    nothing = left.filter("false")
    assert lsh_candidates(nothing, nothing.withColumnRenamed("key", "query_id"), 4, DIM).collect() == []
