"""Registered queries: events, customers, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens import fixed
from shoplens.functions import clean, text as tx
from shoplens.operators import behavior as bh, customers as cu, orders as od, sessions as se
from shoplens.operators.joins import fk_check
from shoplens.plans import sql_parts as sp, tables as t
from shoplens.plans.registry import query
from shoplens.session import work_dir


# --- events -----------------------------------------------------------------

@query("since_days", f"""SELECT eventId, userId, "timestamp" FROM inter
    WHERE "timestamp" >= {t.AS_OF} - 7 * 86400""")
def _since_days(spark, d):
    recent = bh.since_days(t.table(spark, d, "events"), t.AS_OF, 7, "ts")
    return t.interactions_of(recent).select(
        "eventId", "userId", "timestamp")


@query("retention_filter", f"""SELECT eventId, userId, "timestamp" FROM inter
    WHERE "timestamp" >= {t.AS_OF} - 30 * 86400""")
def _retention_filter(spark, d):
    recent = bh.retention_filter(t.table(spark, d, "events"), t.AS_OF, column="ts")
    return t.interactions_of(recent).select(
        "eventId", "userId", "timestamp")


@query("stable_sample", f"""SELECT eventId FROM inter
    WHERE CAST('0x' || substr(md5({sp.EVENT_KEY}), 1, 8) AS BIGINT) % 100000 < 10000""")
def _stable_sample(spark, d):
    return bh.stable_sample(t.interactions(spark, d), 0.1).select("eventId")


@query("events_for_user", "SELECT eventId, itemId, eventType FROM inter WHERE userId = '8'")
def _events_for_user(spark, d):
    own = bh.events_for_user(t.table(spark, d, "events"), 8, "user_id")
    return t.interactions_of(own).select(
        "eventId", "itemId", "eventType")


def _outside(column: str, allowed: list[str]) -> str:
    return f"CASE WHEN {column} NOT IN ({', '.join(sp.quoted(a) for a in allowed)}) THEN '{column}' END"


@query("validate_enums", f"""
    SELECT 'interactions' AS entity, CAST(eventId AS VARCHAR) AS id,
      {_outside('eventType', fixed.EVENT_TYPES)} AS rejected FROM inter
    UNION ALL SELECT 'customers', userId, nullif(concat_ws(',', {_outside('customerSegment', fixed.CUSTOMER_SEGMENTS)},
      {_outside('priceAffinity', fixed.PRICE_AFFINITIES)}), '')
    FROM (SELECT userId, CASE WHEN c_custkey % 11 = 0 THEN 'VIP' ELSE customerSegment END AS customerSegment,
      CASE WHEN c_custkey % 13 = 0 THEN 'low' ELSE priceAffinity END AS priceAffinity FROM cust)""")
def _validate_enums(spark, d):
    """The three closed lists, on events and on customers some of whom break them."""
    events = clean.validate_enums(t.interactions(spark, d), {"eventType": fixed.EVENT_TYPES})
    number = F.col("userId").cast("long")
    people = t.customers(spark, d).withColumns({
        "customerSegment": F.when(number % 11 == 0, "VIP").otherwise(F.col("customerSegment")),
        "priceAffinity": F.when(number % 13 == 0, "low").otherwise(F.col("priceAffinity"))})
    people = clean.validate_enums(people, {"customerSegment": fixed.CUSTOMER_SEGMENTS,
                                           "priceAffinity": fixed.PRICE_AFFINITIES})
    return events.select(F.lit("interactions").alias("entity"), F.col("eventId").cast("string").alias("id"),
                         "rejected").union(people.select(F.lit("customers"), "userId", "rejected"))


@query("recent_n_per_user", """
    SELECT userId, eventId, CAST(rn AS INT) AS recency FROM (SELECT *, row_number() OVER (
      PARTITION BY userId ORDER BY "timestamp" DESC, eventId DESC) AS rn FROM inter)
    WHERE rn <= 10""")
def _recent_n_per_user(spark, d):
    return bh.recent_n_per_user(t.interactions(spark, d)).select("userId", "eventId", "recency")


@query("funnel_mix", """SELECT eventType, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM inter), 6) AS share FROM inter GROUP BY 1""")
def _funnel_mix(spark, d):
    return bh.funnel_mix(t.interactions(spark, d))


@query("funnel_steps", """
    WITH s AS (SELECT userId, itemId,
        min("timestamp") FILTER (eventType = 'view') AS first_view,
        min("timestamp") FILTER (eventType = 'add_to_cart') AS first_cart,
        min("timestamp") FILTER (eventType = 'purchase') AS first_purchase
      FROM inter WHERE eventType IN ('view', 'add_to_cart', 'purchase') GROUP BY ALL),
    g AS (SELECT *, CASE WHEN first_cart >= first_view THEN first_cart - first_view END
        AS view_to_cart, CASE WHEN first_purchase >= first_cart THEN first_purchase - first_cart
        END AS cart_to_purchase FROM s)
    SELECT *, CASE WHEN first_view IS NULL THEN 0 WHEN view_to_cart IS NULL THEN 1
        WHEN cart_to_purchase IS NULL THEN 2 ELSE 3 END AS depth FROM g""")
def _funnel_steps(spark, d):
    return bh.funnel_steps(t.interactions(spark, d))


@query("cart_not_purchased", """
    SELECT userId, itemId, max("timestamp") AS last_cart FROM inter c
    WHERE eventType = 'add_to_cart' GROUP BY userId, itemId
    HAVING NOT EXISTS (SELECT 1 FROM inter p WHERE p.eventType = 'purchase'
      AND p.userId = c.userId AND p.itemId = c.itemId
      AND p."timestamp" >= max(c."timestamp"))""")
def _cart_not_purchased(spark, d):
    return bh.cart_not_purchased(t.interactions(spark, d))


@query("events_with_products", """
    SELECT eventId, i.itemId, p.name AS title, CAST(p.price AS DOUBLE) AS listPrice, productLink
    FROM inter i LEFT JOIN prod p ON p.id = i.itemId""")
def _events_with_products(spark, d):
    rows = bh.events_with_products(t.interactions(spark, d), t.products(spark, d))
    return rows.select("eventId", "itemId", "title", F.col("listPrice").cast("double")
                       .alias("listPrice"), "productLink")


@query("item_interest", """
    SELECT userId, itemId, CAST(sum(eventValue) AS DOUBLE) AS interest, count(*) AS n_events
    FROM inter WHERE eventType IN ('view', 'add_to_cart', 'purchase') GROUP BY userId, itemId""")
def _item_interest(spark, d):
    return bh.item_interest(t.interactions(spark, d), ["userId", "itemId"])


@query("trending_items", f"""
    SELECT itemId, CAST(sum(eventValue) AS DOUBLE) AS interest, count(*) AS n_events FROM inter
    WHERE eventType IN ('view', 'add_to_cart', 'purchase')
      AND "timestamp" >= {t.AS_OF} - 14 * 86400
    GROUP BY itemId ORDER BY interest DESC, itemId LIMIT 20""")
def _trending_items(spark, d):
    recent = bh.since_days(t.table(spark, d, "events"), t.AS_OF, 14, "ts")
    return bh.trending_items(t.interactions_of(recent), t.AS_OF, 14, 20)


@query("distinct_customers_per_item", "SELECT itemId, count(DISTINCT userId) AS customers "
                                      "FROM inter GROUP BY itemId")
def _distinct_customers_per_item(spark, d):
    return bh.distinct_customers_per_item(t.interactions(spark, d))


@query("item_reach", f"""
    SELECT itemId, count(DISTINCT userId) AS customers, true AS close_to_exact FROM inter
    WHERE "timestamp" // 86400 >= {t.AS_OF} // 86400 - 14 GROUP BY itemId""")
def _item_reach(spark, d):
    """Reach of two weeks from daily sketches, held against the exact count."""
    path, rows = work_dir(spark, "reach"), t.interactions(spark, d)
    bh.reach_sketches(rows).write.parquet(path)
    first = t.AS_OF // 86400 - 14
    found = bh.reach(spark.read.parquet(path), first).withColumnRenamed("customers", "estimate")
    exact = bh.distinct_customers_per_item(rows.filter(F.floor(F.col("timestamp") / 86400) >= first))
    near = F.abs(F.col("estimate") - F.col("customers")) <= F.greatest(F.lit(1), F.col("customers") * 0.04)
    return exact.join(found, "itemId", "left").select(
        "itemId", "customers", F.coalesce(near, F.lit(False)).alias("close_to_exact"))


@query("fk_check", """
    SELECT 'l_partkey' AS "column", CAST(l_partkey AS VARCHAR) AS value, count(*) AS n_rows
    FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings) GROUP BY ALL
    UNION ALL
    SELECT 'itemId', itemId, count(*) FROM inter WHERE itemId NOT IN (SELECT id FROM prod)
    GROUP BY ALL
    UNION ALL
    SELECT 'userId', userId, count(*) FROM inter WHERE userId NOT IN (SELECT userId FROM cust)
    GROUP BY ALL""")
def _fk_check(spark, d):
    events = t.interactions(spark, d)
    lines = t.table(spark, d, "lineitem").withColumn(
        "l_partkey", F.col("l_partkey").cast("string"))
    return (fk_check(lines, "l_partkey", t.vectors(spark, d), "key")
            .unionByName(fk_check(events, "itemId", t.products(spark, d), "id"))
            .unionByName(fk_check(events, "userId", t.customers(spark, d), "userId")))


# --- customers --------------------------------------------------------------

_FEATURES = f"""SELECT customerId, count(*) AS n, sum(total) AS spend,
      date_diff('day', max(orderDate), DATE '{t.AS_OF_DATE}') AS last,
      date_diff('day', min(orderDate), DATE '{t.AS_OF_DATE}') AS age
    FROM ords GROUP BY customerId"""


@query("customer_features", f"""
    WITH f AS ({_FEATURES}),
    best AS (SELECT customerId, category, row_number() OVER (PARTITION BY customerId
        ORDER BY count(*) DESC, category) AS rn FROM (SELECT o.customerId, p.categoryL1 AS category
        FROM items i JOIN ords o ON o.id = i.orderId JOIN prod p ON p.id = i.productId)
      GROUP BY customerId, category),
    topics AS (SELECT customerId, theme, row_number() OVER (PARTITION BY customerId
        ORDER BY count(*) DESC, theme) AS rn FROM (SELECT o.customerId, p.theme
        FROM items i JOIN ords o ON o.id = i.orderId JOIN prod p ON p.id = i.productId)
      GROUP BY customerId, theme)
    SELECT f.customerId, n AS lifetimeOrderCount, CAST(spend AS DOUBLE) AS lifetimeSpend,
      (CAST(spend * 200 AS BIGINT) + n) // (2 * n) / 100.0 AS avgOrderValue, last AS daysSinceLastOrder, age AS accountAgeDays, category AS preferredCategoryL1,
      theme AS preferredTheme
    FROM f LEFT JOIN best b ON b.customerId = f.customerId AND b.rn = 1
    LEFT JOIN topics m ON m.customerId = f.customerId AND m.rn = 1""")
def _customer_features(spark, d):
    orders = t.order_keys(spark, d)
    features = cu.customer_features(orders, t.AS_OF_DATE)
    bought = (t.item_keys(spark, d)
              .join(orders.select(F.col("id").alias("orderId"), "customerId"), "orderId")
              .join(t.products(spark, d).select(F.col("id").alias("productId"), "categoryL1",
                                                "theme"), "productId"))
    favourites = cu.preferred_values(bought, "customerId", {
        "preferredCategoryL1": "categoryL1", "preferredTheme": "theme"})
    return (features.join(favourites, "customerId", "left")
            .withColumns({c: F.col(c).cast("double") for c in ("lifetimeSpend", "avgOrderValue")}))


@query("customer_segments", f"""
    WITH f AS (SELECT *, CAST(spend AS DOUBLE) / n AS value FROM ({_FEATURES})),
    s AS (SELECT *, CASE WHEN n >= 15 AND value >= 250000 THEN 'B2B'
        WHEN value >= 250000 THEN 'PREMIUM' WHEN value >= 200000 THEN 'STANDARD'
        ELSE 'BUDGET' END AS customerSegment FROM f)
    SELECT customerId, customerSegment, CASE WHEN customerSegment = 'B2B' THEN 'BULK'
        WHEN value >= 260000 THEN 'HIGH' WHEN value >= 220000 THEN 'MID' ELSE 'LOW' END
        AS priceAffinity FROM s""")
def _customer_segments(spark, d):
    features = cu.customer_features(t.order_keys(spark, d), t.AS_OF_DATE)
    return cu.customer_segments(features, 15, 250000, 200000, 260000, 220000).select(
        "customerId", "customerSegment", "priceAffinity")


@query("order_totals_check", """
    SELECT id AS orderId, CAST(total AS DOUBLE) AS total,
      CAST(coalesce(s, 0) AS DOUBLE) AS items_total FROM ords LEFT JOIN (
      SELECT orderId, sum(quantity * price) AS s FROM items GROUP BY orderId) ON orderId = id
    WHERE total <> coalesce(s, 0)""")
def _order_totals_check(spark, d):
    return od.order_totals_check(t.orders(spark, d), t.items(spark, d)).select(
        "orderId", F.col("total").cast("double").alias("total"),
        F.col("items_total").cast("double").alias("items_total"))


@query("segment_profile_summary", """
    SELECT customerSegment, region, count(*) AS customers, CAST(sum(lifetimeSpend) AS DOUBLE)
      AS spend, count(preferredTheme) AS with_theme,
      CAST(GROUPING(customerSegment, region) AS BIGINT) AS level
    FROM cust GROUP BY ROLLUP (customerSegment, region)""")
def _segment_profile_summary(spark, d):
    return cu.segment_profile_summary(t.customers(spark, d)).withColumn(
        "spend", F.col("spend").cast("double"))


@query("theme_mix", """SELECT customerSegment, region, preferredTheme, count(*) AS customers
    FROM cust GROUP BY ALL""")
def _theme_mix(spark, d):
    return cu.theme_mix(t.customers(spark, d))


@query("customer_typeahead", """SELECT userId, region FROM cust WHERE contains(lower(userId), 'asia')
    OR contains(lower(customerSegment), 'asia') OR contains(lower(region), 'asia')
    OR contains(lower(coalesce(preferredTheme, '')), 'asia') ORDER BY userId LIMIT 50""")
def _customer_typeahead(spark, d):
    return cu.customer_typeahead(t.customers(spark, d), "Asia").select("userId", "region")


@query("list_customers_page", """
    SELECT userId, customerType, customerSegment, region, state, coalesce(preferredTheme, '')
      AS preferredTheme, priceAffinity, CAST(lifetimeSpend AS VARCHAR) AS lifetimeSpend
    FROM cust WHERE userId > '1' ORDER BY userId LIMIT 100""")
def _list_customers_page(spark, d):
    return cu.list_customers_page(t.customers(spark, d), 100, "1")


@query("customer_360", f"""
    WITH o5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customerId
        ORDER BY orderDate DESC, id) AS rn FROM ords) WHERE rn <= 5)
    SELECT userId AS customer_id, 0 AS order_rank, 0 AS item_no, {sp.FORMAT_PROFILE}
      || CASE WHEN userId IN (SELECT customerId FROM o5) THEN ''
         ELSE chr(10) || 'No order history found for this customer.' END AS line FROM cust
    UNION ALL
    SELECT customerId, CAST(rn AS INT), 0, '- Order ' || id || ': ' || status || ' - $' || total
      || ' (' || CAST(orderDate AS VARCHAR) || ')' FROM o5
    UNION ALL
    SELECT customerId, CAST(rn AS INT), itemNo, '  - ' || productName || ' x' || quantity
    FROM o5 JOIN items ON orderId = id""")
def _customer_360(spark, d):
    return cu.customer_360(t.customers(spark, d), t.orders(spark, d), t.items(spark, d),
                           tx.format_profile())


# --- sessions ---------------------------------------------------------------

_FIRST = """coalesce(arg_min(substr(content, 1, 200), turn) FILTER (role = 'USER'), '')"""


@query("first_prompt", f"SELECT actorId, sessionId, {_FIRST} AS firstPrompt FROM msgs "
                       "GROUP BY ALL")
def _first_prompt(spark, d):
    return se.first_prompt(t.messages(spark, d))


_ROLLUP = f"""SELECT actorId, sessionId, min("timestamp") AS createdAt,
    max("timestamp") AS lastEventAt, count(*) AS n_events, {_FIRST} AS firstPrompt
    FROM msgs GROUP BY actorId, sessionId"""


@query("session_rollup", _ROLLUP)
def _session_rollup(spark, d):
    return se.session_rollup(t.messages(spark, d))


SINCE = t.BASE_MS + 30 * 7_200_000


@query("recent_sessions_filter", f"""
    SELECT actorId, sessionId, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (
      PARTITION BY actorId ORDER BY lastEventAt DESC, sessionId) AS rn FROM ({_ROLLUP})
      WHERE lastEventAt >= {SINCE}) WHERE rn <= 3""")
def _recent_sessions_filter(spark, d):
    rows = se.recent_sessions_filter(se.session_rollup(t.messages(spark, d)), SINCE, 3)
    return rows.select("actorId", "sessionId", "place")


@query("list_sessions", f"""
    SELECT actorId, sessionId, createdAt, lastEventAt, n_events, firstPrompt, CAST(rn AS INT)
      AS place FROM (SELECT *, row_number() OVER (PARTITION BY actorId
        ORDER BY lastEventAt DESC, sessionId) AS rn FROM ({_ROLLUP})
      WHERE lastEventAt >= {SINCE}) WHERE rn <= 20""")
def _list_sessions(spark, d):
    return se.list_sessions(t.messages(spark, d), SINCE)


@query("valid_messages", """SELECT sessionId, turn, lower(role) AS role FROM msgs
    WHERE role <> '' AND content <> ''""")
def _valid_messages(spark, d):
    return se.valid_messages(t.messages(spark, d)).select("sessionId", "turn", "role")


@query("session_timeline", """
    SELECT sessionId, turn, lower(role) AS role, "timestamp",
      row_number() OVER w AS position, "timestamp" - lag("timestamp") OVER w AS delay_ms
    FROM msgs WHERE role <> '' AND content <> ''
    WINDOW w AS (PARTITION BY actorId, sessionId ORDER BY "timestamp", turn)""")
def _session_timeline(spark, d):
    return se.session_timeline(t.messages(spark, d)).select(
        "sessionId", "turn", "role", "timestamp", "position", "delay_ms")


@query("session_history", """
    SELECT sessionId, role, content, "timestamp", CAST(rn AS INT) AS position FROM (
      SELECT sessionId, lower(role) AS role, content, "timestamp", row_number() OVER (
        PARTITION BY actorId, sessionId ORDER BY "timestamp", turn) AS rn FROM msgs
      WHERE role <> '' AND content <> '') WHERE rn <= 50""")
def _session_history(spark, d):
    return se.session_history(t.messages(spark, d)).select(
        "sessionId", "role", "content", "timestamp", "position")


@query("recent_events_text", """
    SELECT sessionId, content, CAST(rn AS INT) AS recency FROM (SELECT *, row_number() OVER (
      PARTITION BY actorId, sessionId ORDER BY "timestamp" DESC, turn DESC) AS rn FROM msgs
      WHERE content <> '') WHERE rn <= 3""")
def _recent_events_text(spark, d):
    return se.recent_events_text(t.messages(spark, d), 3).select("sessionId", "content", "recency")
