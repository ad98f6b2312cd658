import pytest
from pyspark.sql import Row, functions as F

from shoplens.operators import joins
from shoplens.sources.index_store import Index, WriteConflict, upsert_union
from shoplens.streaming.streams import NewestChange, apply_changes, stream_index_upsert

RECORD = "key string, vector array<float>, metadata map<string,string>"


def records(spark, **names):
    return spark.createDataFrame([(k, [1.0, 2.0], {"n": v}) for k, v in names.items()], RECORD)


def content(index):
    return {r.key: r.metadata["n"] for r in index.scan().collect()}


@pytest.fixture
def index(spark, tmp_path):
    made = Index(spark, str(tmp_path), "things")
    assert made.stats().first().index_exists is False
    made.replace(records(spark, a="1", b="1"), 2)
    return made


def test_modes(spark, index):
    index.upsert(records(spark, b="2", c="2"))
    assert content(index) == {"a": "1", "b": "2", "c": "2"}
    index.upsert(records(spark, b="2", c="2"))
    assert content(index) == {"a": "1", "b": "2", "c": "2"}
    index.append_new(records(spark, c="3", d="3"))
    assert content(index) == {"a": "1", "b": "2", "c": "2", "d": "3"}
    assert (index.current().added, index.current().skipped) == (1, 1)
    index.append_new(records(spark, c="3", d="3"))
    assert (index.current().added, index.current().skipped) == (0, 2)
    assert tuple(index.stats().first()) == (True, False, 2, "cosine", 4, 2, 2)
    assert {r.key for r in index.get("d").collect()} == {"d"}
    assert {r.key for r in index.get_many(records(spark, a="", x="").select("key")).collect()} == {"a"}
    index.replace(records(spark, z="9"))
    assert content(index) == {"z": "9"}


def test_append_and_upsert_agree_on_keys(spark, tmp_path):
    first, second = records(spark, a="1", b="1"), records(spark, b="2", c="2")
    kept = {}
    for mode in ("append", "upsert"):
        made = Index(spark, str(tmp_path), mode)
        made.write(first, mode)
        made.write(second, mode)
        kept[mode] = set(content(made))
    assert kept["append"] == kept["upsert"]


def test_unfinished_write_is_not_seen(spark, index):
    index._store(records(spark, broken="0"), index.current().parts)
    assert content(index) == {"a": "1", "b": "1"}


def test_changes_apply_once(spark, index):
    rows = [("a", None, None, "delete", 2), ("b", [5.0], {"n": "old"}, "update", 1),
            ("b", [5.0], {"n": "new"}, "update", 2), ("c", [5.0], {"n": "c"}, "create", 1)]
    batch = spark.createDataFrame(rows, RECORD + ", op string, seq int")
    for _ in range(2):
        apply_changes(index, batch)
        assert content(index) == {"b": "new", "c": "c"}


def test_only_touched_parts_are_written(spark, tmp_path):
    made = Index(spark, str(tmp_path), "parts", parts=16)
    made.replace(records(spark, **{f"k{i}": "1" for i in range(200)}), 2)
    before = set(made.current().folders)
    made.upsert(records(spark, k7="2"))
    after = set(made.current().folders)
    assert len(before) == len(after) == 16 and len(before & after) == 15
    assert content(made) == {f"k{i}": "2" if i == 7 else "1" for i in range(200)}
    files = {p: p.stat().st_mtime_ns for f in before & after for p in (tmp_path / "parts" / f).glob("*.parquet")}
    made.change(records(spark, new="3"), records(spark, k7="", k8="").select("key"))
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert content(made) == {f"k{i}": "1" for i in range(200) if i not in (7, 8)} | {"new": "3"}
    assert {r.key for r in made.get("k9").collect()} == {"k9"}
    plan = made.get("k9")._jdf.queryExecution().executedPlan().toString()
    assert "16 paths" not in plan
    removed = made.remove_unnamed(keep=1)
    assert removed > 0 and len(content(made)) == 199 and made.remove_unnamed(keep=1) == 0
    made.upsert(records(spark, k1="9"))
    assert content(made)["k1"] == "9"


def test_two_writers(spark, tmp_path, index):
    """A version number belongs to one writer; a failed write gives it back."""
    with index._writing():
        with pytest.raises(WriteConflict):
            Index(spark, str(tmp_path), "things").upsert(records(spark, a="5"))
    store, claim = index._path("claims/2")[1], index._path("claims/2")[0]
    store.delete(claim, False)
    with pytest.raises(Exception):
        index.upsert(records(spark, a="5").withColumn("metadata", F.raise_error(F.lit("broken")).cast("map<string,string>")))
    index.upsert(records(spark, a="5"))
    assert content(index) == {"a": "5", "b": "1"} and index.current().version == 2


def test_records_without_a_changed_key_are_not_joined(spark):
    old, new = records(spark, a="1", b="1"), records(spark, b="2", c="2")
    got = {r.key: r.metadata["n"] for r in upsert_union(old, new).collect()}
    assert got == {"a": "1", "b": "2", "c": "2"}


def test_late_changes_over_batches(spark, tmp_path):
    """seq 5, then seq 2 in a later batch, keeps 5; a deleted key stays deleted."""
    schema = RECORD + ", op string, seq long"
    source = str(tmp_path / "source")
    batches = [[("a", [5.0], {"n": "5"}, "update", 5), ("b", [1.0], {"n": "b1"}, "create", 1), ("d", [1.0], {"n": "d"}, "create", 1)],
               [("a", [2.0], {"n": "2"}, "update", 2), ("b", None, None, "delete", 4), (None, [1.0], {}, "create", 1)],
               [("b", [3.0], {"n": "b3"}, "update", 3), ("a", [6.0], {"n": "6a"}, "update", 6), ("a", [7.0], {"n": "7"}, "update", 7)],
               [("a", [7.0], {"n": "7"}, "update", 7), ("c", [1.0], {"n": "c"}, "create", 1)]]
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{source}/b={number}")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(source))
    made = Index(spark, str(tmp_path), "live")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream_index_upsert(stream, made, str(tmp_path / "checkpoint")).awaitTermination()
    assert content(made) == {"a": "7", "c": "c", "d": "d"}
    assert made.versions().count() == 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_tombstones_are_forgotten():
    class State:
        value = None
        def exists(self): return self.value is not None  # noqa: E704
        def get(self): return self.value  # noqa: E704
        def update(self, v): self.value = v  # noqa: E704
        def clear(self): self.value = None  # noqa: E704

    class Handle:
        timers = []
        def getValueState(self, *a): return State()  # noqa: E704
        def listTimers(self): return iter(self.timers)  # noqa: E704
        def deleteTimer(self, t): self.timers.remove(t)  # noqa: E704
        def registerTimer(self, t): self.timers.append(t)  # noqa: E704

    def change(op, seq):
        return Row(key="k", vector=None, metadata=None, op=op, seq=seq, arrived_ms=1000)

    p, handle = NewestChange(500), Handle()
    p.init(handle)
    assert [r.seq for r in p.handleInputRows(("k",), iter([change("delete", 3)]), None)] == [3]
    assert handle.timers == [1500] and list(p.handleInputRows(("k",), iter([change("update", 2)]), None)) == []
    list(p.handleExpiredTimer(("k",), None, None))
    assert [r.seq for r in p.handleInputRows(("k",), iter([change("update", 2)]), None)] == [2]


def test_duplicate_keys_in_a_batch(spark, tmp_path):
    made = Index(spark, str(tmp_path), "d")
    made.replace(records(spark, a="1").unionByName(records(spark, a="1")))
    assert content(made) == {"a": "1"}


def test_key_checks(spark, rows):
    child = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    parent = spark.createDataFrame([("y",)], "p string")
    assert rows(joins.fk_check(child, "c", parent, "p")) == [("c", "x", 2), ("c", None, 1)]
    assert rows(joins.valid_children(child, "c", parent, "p")) == [("y",)]


def test_prepare_then_load(spark, tmp_path):
    from shoplens import schemas
    from shoplens.plans import jobs
    from shoplens.sources import files
    (tmp_path / "in.csv").write_text(
        "ITEM_ID,TITLE,PRICE\n1,Kite,$3.50\n2,Ball,4\n1,Kite,$3.50\n,none,1\n")
    out = str(tmp_path / "out")
    manifest = jobs.prepare_batch(spark, "products", str(tmp_path / "in.csv"), out, 1).first()
    assert (manifest.totalRecords, manifest.duplicatesRemoved, manifest.chunkCount) == (2, 1, 2)
    (tmp_path / "r.jsonl").write_text(
        '{"recordId":"1","modelOutput":{"embedding":[1,0]}}\n'
        '{"recordId":"3","modelOutput":{"embedding":[0,1]}}\n'
        '{"recordId":"2","error":{"errorCode":"1","errorMessage":"m"}}\n')
    made = Index(spark, str(tmp_path), "products")
    jobs.load_index(spark, "products", str(tmp_path / "r.jsonl"), f"{out}/raw", made, "upsert", 2)
    got = {r.key: r.metadata for r in made.scan().collect()}
    assert got["1"]["name"] == "Kite" and got["1"]["price"] == "3.5" and got["3"] == {"id": "3"}
    results, _ = files.split_bad(
        files.read_jsonl_lenient(spark, str(tmp_path / "r.jsonl"), schemas.EMBED_RESULT))
    raw = jobs.vectors_of(spark.read.parquet(f"{out}/raw"), "products")
    good = joins.valid_embeddings(results)
    assert [r.key for r in joins.missing_embeddings(raw, good).collect()] == ["2"]
    assert [r.key for r in joins.orphan_embeddings(good, raw).collect()] == ["3"]
    assert [r.key for r in joins.enrich_vectors_strict(good, raw).collect()] == ["1"]


def test_finished_results_are_read_first(spark, tmp_path):
    """Of a folder the .jsonl.out files if there are any, else .jsonl; other files never."""
    from shoplens.plans import jobs
    line = '{"recordId":"%s","modelOutput":{"embedding":[1,0]}}'
    results = tmp_path / "results" / "deep"
    results.mkdir(parents=True)
    (results / "a.jsonl").write_text(line % "request")
    (results / "manifest.json.done").write_text(line % "other")
    raw = spark.createDataFrame([("u", "CONSUMER")], "userId string, customerType string")
    columns = [*("customerSegment", "businessUnit", "preferredCategoryL1", "preferredCategoryL2", "preferredOccasion",
                           "preferredTheme", "priceAffinity", "discountAffinity", "region", "state")]
    raw = raw.selectExpr("*", *[f"cast(null as string) {c}" for c in columns], *[f"cast(null as long) {c}" for c in (
        "accountAgeDays", "lifetimeOrderCount", "daysSinceLastOrder")], *[f"cast(null as decimal(12,2)) {c}" for c in (
            "lifetimeSpend", "avgOrderValue")], "cast(null as boolean) emailOptIn")
    raw.write.parquet(str(tmp_path / "people"))
    made = Index(spark, str(tmp_path), "customers")
    load = lambda mode: jobs.load_index(spark, "customers", str(tmp_path / "results"), str(tmp_path / "people"), made, mode, 2)
    load("upsert")
    assert {r.key for r in made.scan().collect()} == {"request"}
    (results / "a.jsonl.out").write_text(line % "u" + "\n" + line % "v")
    load("append")
    assert {r.key: r.metadata.get("customerType") for r in made.scan().collect()} == {"request": None, "u": "CONSUMER", "v": None}
    load("replace")
    assert {r.key for r in made.scan().collect()} == {"u", "v"}


def test_orders_are_indexed_with_their_items(spark):
    """Ten fields; items as text for the embedder and as JSON with plain prices; an order without items stays."""
    import json
    from decimal import Decimal

    from shoplens.plans import jobs
    orders = spark.createDataFrame([("1", "c", "Ann", Decimal("21.00")), ("2", "c", None, None)],
                                   "id string, customerId string, customerName string, total decimal(12,2)").selectExpr(
        "*", "'Shipped' status", "date'2024-01-02' orderDate", "cast(null as date) deliveryDate",
        "cast(null as string) shippingAddress", "'gift' notes")
    items = spark.createDataFrame([("1", 2, "p2", "Red \"kite\"", 1, Decimal("1.50")), ("1", 1, "p1", "Ball", 3, Decimal("6.00"))],
                                  "orderId string, itemNo int, productId string, productName string, quantity long, price decimal(12,2)")

    def embedder(texts, dimensions):
        import numpy as np
        return np.array([[len(x)] * dimensions for x in texts])

    got = {r.key: r for r in jobs.build_order_vectors(orders, items, 4, embedder).collect()}
    first = got["1"].metadata
    assert json.loads(first["items"]) == [{"productId": "p1", "productName": "Ball", "quantity": 3, "price": 6},
                                          {"productId": "p2", "productName": 'Red "kite"', "quantity": 1, "price": 1.5}]
    assert set(first) == {"orderId", "customerId", "customerName", "items", "total", "status", "orderDate", "deliveryDate",
                          "shippingAddress", "notes"} and first["total"] == "21"
    text = ('order 1 by ann. items: ball (x3), red "kite" (x1). total: $21. status: shipped. ordered: 2024-01-02. '
            "delivery: . address: . notes: gift")
    assert got["1"].vector[0] == len(text) and got["2"].metadata["items"] == "[]"
