import random

from pyspark.sql import functions as F

from shoplens.operators import behavior as bh, dedup as dd

EVENT = "eventId long, userId string, itemId string, timestamp long, eventType string"


def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT)


def test_cart(spark, rows):
    df = events(spark, [("u", "bought", 1, "add_to_cart"), ("u", "bought", 2, "purchase"),
                        ("u", "open", 1, "add_to_cart"),
                        ("u", "before", 1, "purchase"), ("u", "before", 2, "add_to_cart"),
                        ("u", "again", 1, "add_to_cart"), ("u", "again", 2, "purchase"),
                        ("u", "again", 3, "add_to_cart"),
                        ("u", "same", 5, "add_to_cart"), ("u", "same", 5, "purchase"),
                        ("u", "seen", 1, "view")])
    assert rows(bh.cart_not_purchased(df)) == [
        ("u", "again", 3), ("u", "before", 2), ("u", "open", 1)]


def test_funnel(spark):
    df = events(spark, [("u", "full", 1, "view"), ("u", "full", 3, "add_to_cart"),
                        ("u", "full", 9, "purchase"), ("u", "back", 5, "view"),
                        ("u", "back", 2, "add_to_cart"), ("u", "late", 2, "purchase")])
    got = {r.itemId: r for r in bh.funnel_steps(df).collect()}
    assert (got["full"].view_to_cart, got["full"].cart_to_purchase, got["full"].depth) == (2, 6, 3)
    assert (got["back"].view_to_cart, got["back"].depth) == (None, 1)
    assert got["late"].depth == 0


def test_sample_is_stable_and_nested(spark):
    df = events(spark, [(f"u{i % 7}", f"i{i}", i, "view") for i in range(4000)])

    def picked(rate):
        return {r.eventId for r in bh.stable_sample(df, rate).collect()}
    small, large = picked(0.1), picked(0.3)
    assert small < large and picked(0.1) == small
    assert 300 < len(small) < 500 and picked(1.0) == set(range(4000)) and not picked(0.0)


def test_recent_n_with_a_hot_user(spark):
    random.seed(1)
    data = [(random.choice(["hot"] * 6 + ["a", "b"]), "i", random.randint(0, 50), "view")
            for _ in range(3000)]
    df = events(spark, data).repartition(8)
    recent = bh.recent_n_per_user(df, 4)
    want = set()
    for user in {d[0] for d in data}:
        mine = sorted(((d[2], i) for i, d in enumerate(data) if d[0] == user), reverse=True)[:4]
        want |= {(user, i, n) for n, (_, i) in enumerate(mine, 1)}
    assert {(r.userId, r.eventId, r.recency) for r in recent.collect()} == want
    # Each map task cuts a user to four rows before the shuffle.
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedup_properties(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"),
                                ("b", 1, "w"), (None, 1, "n")], "k string, t int, v string")
    once = dd.dedup(df, ["k"], [F.desc("t")])
    assert {r.k: (r.t) for r in once.collect()} == {"a": 2, "b": 1, None: 1}
    assert rows(dd.dedup(once, ["k"], [F.desc("t")])) == rows(once)
    assert rows(dd.dedup(df.repartition(5, "v"), ["k"], [F.desc("t")])) == rows(once)
    assert tuple(dd.dedup_stats(df, ["k"]).first()) == (6, 3, 3)
    assert rows(dd.dedup_keep_first(df, ["k"], "v").select("v")) == [("n",), ("w",), ("x",)]
    assert tuple(dd.dedup_stats(df.limit(0), ["k"]).first()) == (0, 0, 0)


def test_reach(spark):
    df = events(spark, [(f"u{i % 50}", "hot", i, "view") for i in range(500)])
    exact = bh.distinct_customers_per_item(df).first().customers
    near = bh.distinct_customers_per_item(df, approximate=True).first().customers
    assert exact == 50 and abs(near - 50) <= 5


def test_filters_on_stored_columns_reach_the_files(spark):
    """Times and ids are compared in the type of the column."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for df, column in ((bh.since_days(events, 1706745600, 7, "ts"), "ts"),
                       (bh.events_for_user(events, 8, "user_id"), "user_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert f"({column}," in pushed.replace("IsNotNull(", "")
    as_times = events.selectExpr("cast(ts as timestamp) ts", "unix_seconds(cast(ts as timestamp)) timestamp")
    assert bh.since_days(as_times, 1706745600, 7, "ts").count() == bh.since_days(as_times, 1706745600, 7).count() > 0


def test_events_without_an_item_stay_out_of_the_join(spark):
    events = spark.createDataFrame([(1, None), (2, "a"), (3, "x")], "eventId int, itemId string")
    products = spark.createDataFrame([("a", "Kite", 2.0, "l")], "id string, name string, price double, productLink string")
    got = {r.eventId: (r.itemId, r.title, r.listPrice) for r in bh.events_with_products(events, products).collect()}
    assert got == {1: (None, None, None), 2: ("a", "Kite", 2.0), 3: ("x", None, None)}
