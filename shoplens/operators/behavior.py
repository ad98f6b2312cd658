"""Interaction events: filters, recency, funnel, interest, reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoplens import fixed
from shoplens.functions.privacy import hex_bucket
from shoplens.functions.text import event_key
from shoplens.operators.dedup import first_n


def since_days(events: DataFrame, as_of: int, days: int, column: str = "timestamp") -> DataFrame:
    """Events not older than `days` before `as_of` (epoch seconds).

    `column` holds epoch seconds or times. The limit takes the type of the
    column, so on a stored column the filter reaches the files.
    """
    limit = as_of - days * 86400
    kind = events.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        limit = F.timestamp_seconds(F.lit(limit)).cast(kind)    # ntz: in the time zone of the session
    return events.filter(F.col(column) >= limit)


def retention_filter(events: DataFrame, as_of: int, days: int = 30,
                     column: str = "timestamp") -> DataFrame:
    """Events that have not expired yet."""
    return since_days(events, as_of, days, column)


def stable_sample(events: DataFrame, rate: float) -> DataFrame:
    """The same share of events on every run: a hash of user, item and time decides."""
    return events.filter(hex_bucket(event_key(), 100_000) < int(round(rate * 100_000)))


def events_for_user(events: DataFrame, user, column: str = "userId") -> DataFrame:
    """`user` has the type of the column, so on a stored column the filter reaches the files."""
    return events.filter(F.col(column) == F.lit(user))


def recent_n_per_user(events: DataFrame, n: int = 10) -> DataFrame:
    """Last n events of each user, newest first, as `recency` 1..n."""
    return first_n(events, ["userId"],
                   [F.desc("timestamp"), F.desc("eventId")], n, rank="recency")


def _weight(kind: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in weights.items()], F.lit(0.0))


def funnel_mix(events: DataFrame) -> DataFrame:
    """Count and share per event type. The total is one number over the type counts."""
    counts = events.groupBy("eventType").agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.select("eventType", "n", F.round(F.col("n") / total, 6).alias("share"))


def funnel_steps(events: DataFrame) -> DataFrame:
    """First view, cart and purchase per user and item, with the gaps between them.

    One aggregate with map-side combine. A gap is null when its steps are
    missing or came in the other order; `depth` counts the steps in order.
    """
    def first(kind: str) -> Column:
        return F.min(F.when(F.col("eventType") == kind, F.col("timestamp")))

    def gap(start: str, end: str) -> Column:
        return F.when(F.col(end) >= F.col(start), F.col(end) - F.col(start))

    steps = (events.filter(F.col("eventType").isin(fixed.EVENT_TYPES))
             .groupBy("userId", "itemId")
             .agg(first("view").alias("first_view"), first("add_to_cart").alias("first_cart"),
                  first("purchase").alias("first_purchase")))
    steps = steps.withColumns({"view_to_cart": gap("first_view", "first_cart"),
                               "cart_to_purchase": gap("first_cart", "first_purchase")})
    depth = (F.when(F.col("first_view").isNull(), 0)
              .when(F.col("view_to_cart").isNull(), 1)
              .when(F.col("cart_to_purchase").isNull(), 2).otherwise(3))
    return steps.withColumn("depth", depth)


def cart_not_purchased(events: DataFrame) -> DataFrame:
    """User and item whose last cart has no purchase at the same time or later.

    Some purchase follows a cart exactly when the last one does, so one
    aggregate with map-side combine replaces the range join.
    """
    def last(kind: str) -> Column:
        return F.max(F.when(F.col("eventType") == kind, F.col("timestamp")))

    per_pair = (events.filter(F.col("eventType").isin("add_to_cart", "purchase"))
                .groupBy("userId", "itemId")
                .agg(last("add_to_cart").alias("last_cart"),
                     last("purchase").alias("last_purchase")))
    open_cart = F.col("last_purchase").isNull() | (F.col("last_purchase") < F.col("last_cart"))
    return per_pair.filter(F.col("last_cart").isNotNull() & open_cart).select(
        "userId", "itemId", "last_cart")


def events_with_products(events: DataFrame, products: DataFrame) -> DataFrame:
    """Events with title, price and link of their item; unknown items stay.

    No hint: Spark broadcasts the products only when their measured size is
    small, and splits a hot item's partition otherwise.
    """
    right = products.select(F.col("id").alias("itemId"), F.col("name").alias("title"),
                            F.col("price").alias("listPrice"), "productLink")
    # Events without an item match nothing and would all go to one task.
    known = events.filter(F.col("itemId").isNotNull()).join(right, "itemId", "left")
    none = events.filter(F.col("itemId").isNull()).select("*", *[
        F.lit(None).cast(right.schema[c].dataType).alias(c) for c in ("title", "listPrice", "productLink")])
    return known.unionByName(none)


def item_interest(events: DataFrame, keys: list[str],
                  weights: dict[str, float] = fixed.EVENT_WEIGHTS) -> DataFrame:
    """Weighted interest per item, or per user and item."""
    return (events.filter(F.col("eventType").isin(list(weights)))
            .groupBy(*keys).agg(F.sum(_weight(F.col("eventType"), weights)).alias("interest"),
                                F.count("*").alias("n_events")))


def trending_items(events: DataFrame, as_of: int, days: int, k: int) -> DataFrame:
    """Top k items by interest within the last `days`."""
    recent = since_days(events, as_of, days)
    return item_interest(recent, ["itemId"]).orderBy(F.desc("interest"), "itemId").limit(k)


def distinct_customers_per_item(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Users reached per item. The exact form shuffles distinct pairs, not events."""
    if approximate:
        return events.groupBy("itemId").agg(F.hll_sketch_estimate(F.hll_sketch_agg("userId", 14)).alias("customers"))
    return events.groupBy("itemId").agg(F.count_distinct("userId").alias("customers"))


def reach_sketches(events: DataFrame, size: int = 14, column: str = "timestamp") -> DataFrame:
    """A mergeable HyperLogLog sketch of the users per item and day, to be stored.

    `size`: base-2 logarithm of the registers; the standard error is 1.04 / sqrt(2**size).
    """
    day = F.floor(F.col(column) / F.lit(86400)).cast("int").alias("day")
    return events.groupBy("itemId", day).agg(F.hll_sketch_agg("userId", size).alias("users"))


def reach(sketches: DataFrame, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """Users reached per item in any period, from stored sketches; events are not read again."""
    if first_day is not None:
        sketches = sketches.filter(F.col("day") >= first_day)
    if last_day is not None:
        sketches = sketches.filter(F.col("day") <= last_day)
    return sketches.groupBy("itemId").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("customers"))
