"""Orders with items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def item_lists(items: DataFrame) -> DataFrame:
    """Items per order as one ordered array of structs, of those fields the items have."""
    fields = [f for f in ("itemNo", "productId", "productName", "quantity", "price") if f in items.columns]
    return (items.groupBy("orderId")
            .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items")))


def flatten_items(orders: DataFrame) -> DataFrame:
    """Nested `items` of orders to one row per item."""
    return (orders.select(F.col("id").alias("orderId"), F.posexplode("items"))
            .select("orderId", (F.col("pos") + 1).alias("itemNo"), "col.*"))


def order_totals_check(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose total differs from the sum of quantity times price of the items."""
    sums = items.groupBy("orderId").agg(
        F.sum(F.col("quantity") * F.col("price")).cast("decimal(24,2)").alias("items_total"))
    joined = orders.select(F.col("id").alias("orderId"), "total").join(sums, "orderId", "left")
    total = F.coalesce(F.col("items_total"), F.lit(0).cast("decimal(24,2)"))
    return (joined.withColumn("items_total", total)
            .withColumn("difference", F.col("total") - total)
            .filter(F.col("difference") != 0))
