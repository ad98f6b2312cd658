import json
import random

from pyspark.sql import functions as F

from shoplens import fixed, schemas
from shoplens.functions import metadata as md, text as tx


def product(spark, **values):
    row = {f.name: None for f in schemas.PRODUCT.fields} | values
    return spark.createDataFrame([row], schemas.PRODUCT)


def customer(spark, **values):
    row = {f.name: None for f in schemas.CUSTOMER.fields} | values
    return spark.createDataFrame([row], schemas.CUSTOMER)


def one(df, column):
    return df.select(column.alias("x")).first().x


def test_product_text(spark):
    from decimal import Decimal
    df = product(spark, id="1", name="Kite", description="Flies", price=Decimal("30.00"),
                 categoryL1="Toys", categoryL2="Air", categoryL3="Kites", theme="Sky",
                 salePrice=Decimal("12.50"), inStock=False, brand="B", material="silk")
    assert one(df, tx.product_text()) == (
        "Product: Kite. Category: Toys. > Air. > Kites. Theme: Sky. Description: Flies. "
        "Price: $30. Sale Price: $12.5. Material: silk. Out of stock. Brand: B")
    assert one(df, tx.product_text(rich=False)) == (
        "Product: Kite. Category: Toys. > Air. Theme: Sky. Description: Flies. "
        "Price: $30. Out of stock. Brand: B")


def test_customer_text(spark):
    from decimal import Decimal
    df = customer(spark, userId="C1", region="Austin", lifetimeOrderCount=0,
                  lifetimeSpend=Decimal("100.00"), daysSinceLastOrder=3)
    assert one(df, tx.customer_text()) == (
        "Customer: C1. Orders: 0. Lifetime Spend: $100. Days Since Last Order: 3")
    assert one(df, tx.customer_text(rich=False)) == "Customer: C1. Lifetime Spend: $100"
    assert one(df, tx.format_profile()) == (
        "Customer ID: C1\nLifetime Orders: 0\nLifetime Spend: $100.00\nDays Since Last Order: 3")


def test_interaction(spark):
    from decimal import Decimal
    rows = [("u", "i", 1700000000, "view", 1.0, 0, Decimal("2.50"), " Trending "),
            ("u", None, None, None, None, 3, None, "")]
    df = spark.createDataFrame(rows, schemas.INTERACTION)
    text = [r.x for r in df.select(tx.interaction_text().alias("x")).collect()]
    assert text == ["User u performed view on item i. at timestamp 1700000000. price $2.5. "
                    "via Trending", "User u performed event on item . quantity 3"]
    assert [r.x for r in df.select(tx.event_key().alias("x")).collect()] == [
        "u_i_1700000000", "u__"]
    assert df.select(tx.format_event_line().alias("x")).first().x == (
        "- 2023-11-14: view i ($2.5) via  Trending ")


def test_query_texts(spark):
    df = spark.createDataFrame(
        [("Space", None, None, "red", "kids", 12, "low", "x"), (None,) * 8],
        "theme string, occasion string, category string, color string, ageGroup string, "
        "guestCount int, budget string, keywords string")
    got = [r.x for r in df.select(tx.criteria_query_text().alias("x")).collect()]
    assert got == ["Space red colored for kids 12 guests budget-friendly affordable x",
                   fixed.DEFAULT_CRITERIA_TEXT]
    profile = customer(spark, userId="1", preferredCategoryL1="A", preferredCategoryL2="B",
                       priceAffinity="HIGH")
    assert one(profile, tx.profile_query_text()) == "B premium upscale"
    empty = customer(spark, userId="1", priceAffinity="high")
    assert one(empty, tx.profile_query_text()) == fixed.DEFAULT_PROFILE_TEXT
    spaced = spark.createDataFrame([("  A \n  b ",)], "t string")
    assert one(spaced, tx.normalize_query_text(F.col("t"))) == "a b"


def test_tips(spark):
    df = customer(spark, userId="1", preferredTheme="Sky", priceAffinity="BULK",
                  daysSinceLastOrder=90, lifetimeOrderCount=11)
    assert one(df, tx.profile_tips()).split("\n") == [
        fixed.TIP_THEME % "Sky", fixed.TIP_BULK, fixed.TIP_LOYAL]


def test_placeholders_unknown_stay(spark):
    df = spark.range(1).select(tx.fill_placeholders("a {{X}} {{Y}}", {"X": F.lit("1")}).alias("x"))
    assert df.first().x == "a 1 {{Y}}"


def capped(values: dict, cap=1800):
    """Brute force of the byte cap."""
    m = dict(values)

    def size():
        kept = {k: v for k, v in m.items() if k not in fixed.NON_FILTERABLE_KEYS}
        return len(json.dumps(kept, ensure_ascii=False, separators=(",", ":")).encode())
    for _ in range(20):
        if size() <= cap:
            break
        long = [(len(v), k) for k, v in m.items()
                if k not in fixed.NON_FILTERABLE_KEYS and len(v) > 20]
        if not long:
            break
        most = max(n for n, _ in long)
        key = next(k for n, k in long if n == most)
        m[key] = m[key][:max(most - 200, 20)]
    return m


def test_byte_cap(spark):
    random.seed(3)
    letters = 'abcdefgh é"\\\n日'
    cases = [{"a": "x" * 1900}, {"a": "x" * 900, "b": "y" * 900, "c": "z" * 900},
             {"name": "n" * 5000}, {"a": "é" * 2000, "name": "n" * 3000}, {"a": "short"},
             {"a": "x" * 9000}, {f"k{i}": "v" * 20 for i in range(90)}]
    for _ in range(30):
        cases.append({k: "".join(random.choices(letters, k=random.randint(0, 1500)))
                      for k in random.sample(["a", "b", "c", "name", "link"], 3)})
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m map<string,string>")
    got = {r.i: r.m for r in df.select("i", md.metadata_byte_cap(F.col("m")).alias("m")).collect()}
    for i, case in enumerate(cases):
        assert got[i] == capped(case), i


def test_typed_profile_round_trip(spark):
    from decimal import Decimal
    df = customer(spark, userId="7", customerType="BUSINESS", lifetimeOrderCount=4,
                  lifetimeSpend=Decimal("10.50"), emailOptIn=True, state="TX")
    rows = df.select(md.customer_metadata().alias("m"))
    profile = rows.select(md.typed_profile(F.col("m"), F.lit("7")).alias("p")).first().p
    assert (profile.userId, profile.customerType, profile.lifetimeOrderCount,
            profile.lifetimeSpend, profile.emailOptIn, profile.state, profile.region) == (
        "7", "BUSINESS", 4, 10.5, True, "TX", None)
