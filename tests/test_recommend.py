import numpy as np
from pyspark.sql import functions as F

from shoplens import fixed
from shoplens.operators import recommend as rec
from shoplens.operators.orders import item_lists
from shoplens.plans import jobs, queries_search

PROFILE = ("customerId string, customerType string, preferredTheme string, "
           "preferredOccasion string, priceAffinity string")


def candidates(spark, rows, profile=("c", "BUSINESS", "Space", "Birthday", "MID")):
    left = spark.createDataFrame([("c", k, s, r, m) for k, s, r, m in rows],
                                 "customerId string, key string, score double, base_rank int, "
                                 "metadata map<string,string>")
    return left.join(spark.createDataFrame([profile], PROFILE), "customerId")


def test_each_bonus(spark):
    rows = [("theme", 0.5, 1, {"theme": "Outer SPACE"}),
            ("occasion", 0.5, 2, {"occasion": "birthday, wedding"}),
            ("from theme", 0.5, 3, {"theme": "birthday"}),
            ("low edge", 0.5, 4, {"price": "20"}), ("high edge", 0.5, 5, {"price": "80"}),
            ("over", 0.5, 6, {"price": "80.01"}), ("free", 0.5, 7, {"price": "0"}),
            ("bad price", 0.5, 8, {"price": "n/a"}), ("bulk", 0.5, 9, {"isBulk": "bulk"}),
            ("all", 0.5, 10, {"theme": "space", "occasion": "Birthday", "price": "30",
                              "bulkAssortments": "Bulk"}),
            ("none", 0.5, 11, {})]
    got = {r.key: r.bonus for r in rec.rerank_by_profile(candidates(spark, rows)).collect()}
    assert got == {"theme": 0.1, "occasion": 0.08, "from theme": 0.08, "low edge": 0.05,
                   "high edge": 0.05, "over": 0.0, "free": 0.0, "bad price": 0.0, "bulk": 0.05,
                   "all": 0.28, "none": 0.0}


def test_unknown_profile_changes_nothing(spark):
    rows = [("a", 0.5, 1, {"theme": "space", "price": "30", "isBulk": "bulk"})]
    got = rec.rerank_by_profile(candidates(spark, rows, ("c", None, None, None, "OTHER"))).first()
    assert (got.score, got.bonus) == (0.5, 0.0)


def test_ties_keep_search_order(spark):
    rows = [("b", 0.5, 2, {}), ("a", 0.5, 1, {}), ("c", 0.9, 3, {})]
    got = rec.topk_per_customer(candidates(spark, rows), 2, ["customerId"])
    assert [(r.key, r.position) for r in got.orderBy("position").collect()] == [("c", 1), ("a", 2)]


def test_ranking_in_the_row_equals_ranking_by_window(spark):
    rows = [(f"k{i}", (i * 7 % 10) / 10, i, {"theme": "space" if i % 3 else "x", "price": str(i)})
            for i in range(30)]
    flat = candidates(spark, rows)
    by_window = rec.topk_per_customer(rec.rerank_by_profile(flat), 5, ["customerId"])
    hits = flat.select(F.col("customerId").alias("query_id"), "key", "score",
                       F.col("base_rank").alias("rank"), "metadata")
    asker = spark.createDataFrame([("c", "BUSINESS", "Space", "Birthday", "MID")], PROFILE)
    pools = rec.candidate_pools(hits, False).withColumnRenamed("query_id", "customerId")
    in_row = rec.unfold_best(rec.rank_pools(asker.join(pools, "customerId"), 5))
    fields = ["customerId", "key", "score", "bonus", "base_rank", "position"]
    assert sorted(map(tuple, in_row.select(fields).collect())) == sorted(
        map(tuple, by_window.select(fields).collect()))


def test_in_stock(spark):
    maps = [{}, {"availability": ""}, {"availability": "In Stock now"},
            {"availability": "sold out"}, {"inStock": "true"}, {"inStock": "false"},
            {"inStock": "out of stock"}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)],
                               "i int, metadata map<string,string>")
    assert sorted(r.i for r in rec.in_stock_only(df).collect()) == [0, 1, 2, 4]


def test_price_bands(spark):
    df = spark.createDataFrame([("low",), ("MID",), ("x",), (None,)], "a string")
    low, high = rec.price_band(F.col("a"))
    assert [tuple(r) for r in df.select(low, high).collect()] == [
        (0.0, 30.0), (20.0, 80.0), (None, None), (None, None)]


def test_card_fallbacks(spark):
    df = spark.createDataFrame(
        [("1", {"title": "T", "categoryL1": "A", "categoryL2": "B", "description": "d" * 400}),
         ("2", {"name": "", "price": "5"})], "key string, m map<string,string>")
    card = rec.product_card(F.col("key"), F.col("m"), F.lit(1.0)).alias("c")
    first, second = [r.c for r in df.select(card).collect()]
    assert (first.title, first.category, len(first.description)) == ("T", "B", 300)
    assert (second.title, second.price, second.description) == ("2", "5", None)


def test_merge_first_appearance(spark, rows):
    lists = [spark.createDataFrame([("c", x, n, p) for x, p in part],
                                   "c string, id string, list_no int, position int")
             for n, part in ((1, [("a", 1), ("b", 2)]), (2, [("b", 1), ("d", 2)]))]
    got = rec.merge_tool_results(lists, ["c"]).select("id", "list_no", "position")
    assert rows(got) == [("a", 1, 1), ("b", 1, 2), ("d", 2, 2)]


def test_empty_catalog_gives_the_built_in_facets(spark):
    from shoplens.operators.facets import facet_counts, facet_fallback
    schema = "theme string, occasion string, categoryL1 string, color string"
    empty = facet_fallback(facet_counts(spark.createDataFrame([], schema)))
    assert empty.count() == sum(len(v) for v in fixed.FALLBACK_FACETS.values())
    live = facet_counts(spark.createDataFrame([(" Sky ", None, "", "Red"), ("Sky", "", "", "Blue"),
                                               (None, None, None, "Blue")], schema))
    assert sorted(map(tuple, facet_fallback(live).collect())) == [
        ("colors", "Blue", 2, 1), ("colors", "Red", 1, 2), ("themes", "Sky", 2, 1)]


def test_equal_texts_are_embedded_once(spark):
    """A filter on the vector must not pull the embedder below `distinct`."""
    def embedder(texts, dimensions):
        assert len(texts) == 1, "a text was embedded more than once"
        return np.eye(1, dimensions).repeat(len(texts), 0)

    index = spark.createDataFrame([("a", [1.0, 0.0], {"name": "A"}), ("b", [0.0, 1.0], {"name": "B"})],
                                  "key string, vector array<float>, metadata map<string,string>")
    queries = spark.range(0, 200, 1, 1).select(F.col("id").alias("query_id"), F.lit("same text").alias("query"))
    found = jobs.search(index, queries, 1, 2, embedder).collect()
    assert len(found) == 200 and {(r.key, r.metadata["name"]) for r in found} == {("a", "A")}


def test_metadata_is_made_for_winners_only(spark):
    index = spark.createDataFrame([(str(i), [1.0, i / 50]) for i in range(50)], "key string, vector array<float>")
    made = F.when(F.col("key") == "0", F.create_map(F.lit("name"), F.col("key"))).otherwise(
        F.raise_error(F.lit("made for a row that is no winner")).cast("map<string,string>"))
    queries = spark.createDataFrame([("q", "x")], "query_id string, query string")
    found = jobs.search(index, queries, 1, 2, lambda texts, n: np.eye(1, n).repeat(len(texts), 0),
                        records=lambda hits: index.select("key", made.alias("metadata"))).collect()
    assert [(r.key, r.metadata) for r in found] == [("0", {"name": "0"})]


def test_metadata_of_candidates_is_joined_last(spark):
    plan = queries_search._profiled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "(key#" in next(line for line in plan.splitlines() if "Join" in line)


def test_items_without_prices_make_the_same_text(spark):
    orders = spark.sql("select '1' id, 'c' customerId, 'C' customerName, 9.5 total, 'new' status, date'2024-01-02' orderDate, "
                       "date'2024-01-03' deliveryDate, 'here' shippingAddress, 'none' notes")
    items = spark.createDataFrame([("1", 2, "p", "Bolt", 1, 2.0), ("1", 1, "q", "Gear", 3, 1.0), ("1", 1, "q", "Gear", 3, None),
                                   ("1", None, "r", "Rod", 2, 1.0)],
                                  "orderId string, itemNo int, productId string, productName string, quantity long, price double")
    want = jobs.build_order_vectors(orders, items, 8).select("key", "vector").collect()
    assert jobs.embed_orders(orders, items, 8).collect() == want
    assert "price" not in item_lists(items.drop("price")).schema["items"].simpleString()
    assert [r.itemNo for r in item_lists(items).first()["items"]] == [None, 1, 1, 2]
