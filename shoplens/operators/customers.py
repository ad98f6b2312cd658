"""Customer features, segments, lookup pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoplens.functions.text import money
from shoplens.operators.dedup import first_n

TYPEAHEAD_FIELDS = ["userId", "customerSegment", "region", "preferredTheme"]


def preferred_values(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Most frequent value per key of several columns, ties to the smaller value.

    `columns` maps output name to input column. The input is read once: each
    row counts towards every column, and counts combine before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("_name"), F.col(c).cast("string").alias("_value"))
                      for name, c in columns.items()])
    counts = (rows.select(key, F.inline(pairs)).filter(F.col("_value").isNotNull())
              .groupBy(key, "_name", "_value").agg(F.count("*").alias("_n")))
    rank = F.struct(-F.col("_n"), F.col("_value"))

    def best(name: str) -> Column:
        mine = F.col("_name") == name
        return F.min_by(F.when(mine, F.col("_value")), F.when(mine, rank)).alias(name)

    return counts.groupBy(key).agg(*[best(name) for name in columns])


def customer_features(orders: DataFrame, as_of: str) -> DataFrame:
    """Order count, spend, average order, recency and account age per customer.

    `orders(customerId, total, orderDate)`; account age runs from the first order.
    """
    today = F.lit(as_of).cast("date")
    return (orders.groupBy("customerId").agg(
        F.count("*").alias("lifetimeOrderCount"),
        F.sum("total").cast(T.DecimalType(18, 2)).alias("lifetimeSpend"),
        F.max("orderDate").alias("_last"), F.min("orderDate").alias("_first"))
        .select("customerId", "lifetimeOrderCount", "lifetimeSpend",
                (F.col("lifetimeSpend") / F.col("lifetimeOrderCount"))
                .cast(T.DecimalType(18, 2)).alias("avgOrderValue"),
                F.datediff(today, F.col("_last")).cast("long").alias("daysSinceLastOrder"),
                F.datediff(today, F.col("_first")).cast("long").alias("accountAgeDays")))


def customer_segments(features: DataFrame, bulk_orders: int = 20, premium_value: float = 80,
                      standard_value: float = 40, high_value: float = 80,
                      mid_value: float = 40) -> DataFrame:
    """Segment and price affinity by thresholds on order count and average order."""
    count, value = F.col("lifetimeOrderCount"), F.col("avgOrderValue")
    segment = (F.when((count >= bulk_orders) & (value >= premium_value), "B2B")
                .when(value >= premium_value, "PREMIUM")
                .when(value >= standard_value, "STANDARD").otherwise("BUDGET"))
    rows = features.withColumn("customerSegment", segment)
    affinity = (F.when(F.col("customerSegment") == "B2B", "BULK")
                 .when(value >= high_value, "HIGH").when(value >= mid_value, "MID")
                 .otherwise("LOW"))
    return rows.withColumn("priceAffinity", affinity)


def segment_profile_summary(customers: DataFrame) -> DataFrame:
    """Customers, spend and share with a theme per segment and region, with totals."""
    return (customers.rollup("customerSegment", "region").agg(
        F.count("*").alias("customers"),
        F.sum("lifetimeSpend").cast("decimal(24,2)").alias("spend"),
        F.count("preferredTheme").alias("with_theme"),
        F.grouping_id().cast("long").alias("level")))


def theme_mix(customers: DataFrame) -> DataFrame:
    """Customers per segment, region and preferred theme."""
    return customers.groupBy("customerSegment", "region", "preferredTheme").agg(
        F.count("*").alias("customers"))


def customer_typeahead(customers: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """First customers by id whose id, segment, region or theme contains the query."""
    wanted = query.lower()
    if wanted.strip():
        hit = F.lit(False)
        for name in TYPEAHEAD_FIELDS:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(wanted))
        customers = customers.filter(hit)
    return customers.orderBy("userId").limit(limit)


def list_customers_page(customers: DataFrame, limit: int = 500,
                        after: str | None = None) -> DataFrame:
    """One page by id: eight fields, blanks for missing ones; `after` is the last id seen."""
    fields = ["customerType", "customerSegment", "region", "state", "preferredTheme",
              "priceAffinity"]
    rows = customers if after is None else customers.filter(F.col("userId") > after)
    return rows.orderBy("userId").limit(limit).select(
        "userId", *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields],
        F.coalesce(money(F.col("lifetimeSpend")), F.lit("")).alias("lifetimeSpend"))


def recent_orders(orders: DataFrame, n: int = 5) -> DataFrame:
    """Latest n orders per customer as `order_rank`."""
    return first_n(orders, ["customerId"], [F.desc("orderDate"), F.asc("id")], n,
                   rank="order_rank")


def order_line() -> Column:
    return F.concat(
        F.lit("- Order "), F.col("id"), F.lit(": "), F.coalesce("status", F.lit("Unknown")),
        F.lit(" - $"), F.coalesce(money(F.col("total")), F.lit("0")), F.lit(" ("),
        F.coalesce(F.date_format("orderDate", "yyyy-MM-dd"), F.lit("Unknown date")), F.lit(")"))


def customer_360(customers: DataFrame, orders: DataFrame, items: DataFrame,
                 profile_text: Column, n: int = 5) -> DataFrame:
    """Lines of the account view: profile, then up to n recent orders with items.

    One row per line `(customer_id, order_rank, item_no, line)`, so a customer
    or an order with very many rows is spread over tasks like any other. Rank
    0 holds the profile, item 0 the order itself. Either side may be missing.
    Orders are cut to n per customer before the items are read.
    """
    latest = recent_orders(orders, n)
    none = F.lit("No customer profile found for ID: ")
    profiles = (customers.withColumn("_profile", profile_text)
                .select(F.col("userId").alias("customer_id"), "_profile"))
    buyers = latest.select(F.col("customerId").alias("customer_id")).distinct()
    heads = profiles.join(buyers.withColumn("_buys", F.lit(True)), "customer_id", "full").select(
        "customer_id", F.lit(0).alias("order_rank"), F.lit(0).alias("item_no"),
        F.concat(F.coalesce("_profile", F.concat(none, F.col("customer_id"))),
                 F.when(F.col("_buys").isNull(),
                        F.lit("\nNo order history found for this customer."))
                  .otherwise(F.lit(""))).alias("line"))
    headers = latest.select(F.col("customerId").alias("customer_id"), "order_rank",
                            F.lit(0).alias("item_no"), order_line().alias("line"))
    lines = (items.join(latest.select(F.col("id").alias("orderId"),
                                      F.col("customerId").alias("customer_id"), "order_rank"),
                        "orderId")
             .select("customer_id", "order_rank", F.col("itemNo").alias("item_no"),
                     F.concat(F.lit("  - "), F.col("productName"), F.lit(" x"),
                              F.col("quantity").cast("string")).alias("line")))
    return heads.unionByName(headers).unionByName(lines)
