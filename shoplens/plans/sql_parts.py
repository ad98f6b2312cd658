"""SQL pieces shared by the check queries."""

from __future__ import annotations

from shoplens import fixed
from shoplens.plans.tables import BANDS, DIMENSIONS, plain_sql


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pairs_sql(pairs: dict[str, str]) -> str:
    """`key=value` texts in key order, joined by `|`, nulls left out."""
    parts = [f"'{k}=' || CAST({v} AS VARCHAR)"
             for k, v in sorted(pairs.items(), key=lambda kv: kv[0] + "=")]
    return f"concat_ws('|', {', '.join(parts)})"


PRODUCT_TEXT = f"""concat_ws('. ', 'Product: ' || name, 'Category: ' || categoryL1,
    '> ' || categoryL2, '> ' || categoryL3, 'Theme: ' || theme, 'Occasion: ' || occasion,
    'Holiday: ' || holiday, 'Description: ' || description, 'Price: $' || {plain_sql('price')},
    'Sale Price: $' || {plain_sql('salePrice')}, 'Color: ' || color,
    'Age Group: ' || ageGroup, CASE WHEN inStock THEN 'In stock' ELSE 'Out of stock' END,
    'Brand: ' || brand, 'Manufacturer: ' || manufacturer)"""

CUSTOMER_TEXT = f"""concat_ws('. ', 'Customer: ' || userId, 'Type: ' || customerType,
    'Segment: ' || customerSegment, 'Preferred Category: ' || preferredCategoryL1,
    'Preferred Theme: ' || preferredTheme, 'Preferred Occasion: ' || preferredOccasion,
    'Price Affinity: ' || priceAffinity, 'Discount Affinity: ' || discountAffinity,
    'Location: ' || region || ', ' || state, 'Orders: ' || lifetimeOrderCount,
    'Lifetime Spend: $' || {plain_sql('lifetimeSpend')},
    'Avg Order: $' || {plain_sql('avgOrderValue')},
    'Days Since Last Order: ' || daysSinceLastOrder)"""

INTERACTION_TEXT = f"""concat_ws('. ', 'User ' || userId || ' performed ' || eventType
    || ' on item ' || itemId, 'at timestamp ' || "timestamp",
    CASE WHEN quantity <> 0 THEN 'quantity ' || quantity END,
    CASE WHEN price <> 0 THEN 'price $' || {plain_sql('price')} END,
    'via ' || recommendationId)"""

ORDER_TEXT = f"""'Order ' || id || ' by ' || customerName || '. Items: ' || names || '. Total: $'
    || {plain_sql('total')} || '. Status: ' || status || '. Ordered: '
    || CAST(orderDate AS VARCHAR) || '. Delivery: ' || CAST(deliveryDate AS VARCHAR)
    || '. Address: . Notes: ' || notes"""

ORDER_META = {
    "orderId": "id", "customerId": "customerId", "customerName": "customerName", "items": "js",
    "total": plain_sql("total"), "status": "status", "orderDate": "orderDate",
    "deliveryDate": "deliveryDate", "shippingAddress": "''", "notes": "notes"}

EVENT_KEY = """userId || '_' || itemId || '_' || "timestamp\""""

PRODUCT_META = {
    "name": "name", "description": "description", "price": plain_sql("price"),
    "inStock": "inStock", "link": "productLink", "image": "imageLink",
    "category": "categoryL1", "categoryL1": "categoryL1", "categoryL2": "categoryL2",
    "categoryL3": "categoryL3", "theme": "theme", "occasion": "occasion", "holiday": "holiday",
    "color": "color", "ageGroup": "ageGroup", "brand": "brand", "manufacturer": "manufacturer",
    "salePrice": plain_sql("salePrice"), "isBulk": "CASE WHEN isBulk THEN 'bulk' END",
}
CUSTOMER_META = {
    **{c: c for c in ("userId", "customerType", "customerSegment", "businessUnit",
                      "preferredCategoryL1", "preferredCategoryL2", "preferredOccasion",
                      "preferredTheme", "priceAffinity", "discountAffinity", "region", "state",
                      "accountAgeDays", "lifetimeOrderCount", "daysSinceLastOrder",
                      "emailOptIn")},
    "lifetimeSpend": plain_sql("lifetimeSpend"), "avgOrderValue": plain_sql("avgOrderValue"),
}
INTERACTION_META = {
    "userId": "userId", "itemId": "itemId", "eventType": "eventType",
    "eventValue": "CAST(eventValue AS DOUBLE)", "quantity": "quantity",
    "price": plain_sql("price"), "timestamp": '"timestamp"',
    "recommendationId": "recommendationId",
}

FORMAT_PROFILE = """concat_ws(chr(10), 'Customer ID: ' || userId, 'Type: ' || customerType,
    'Segment: ' || customerSegment, 'Preferences: ' || concat_ws(', ',
      'Category: ' || preferredCategoryL1, 'Theme: ' || preferredTheme,
      'Occasion: ' || preferredOccasion),
    'Price Affinity: ' || priceAffinity, 'Location: ' || region || ', ' || state,
    'Lifetime Orders: ' || lifetimeOrderCount, 'Lifetime Spend: $' || lifetimeSpend,
    'Avg Order Value: $' || avgOrderValue, 'Days Since Last Order: ' || daysSinceLastOrder)"""

PROFILE_TIPS = f"""concat_ws(chr(10),
    {quoted(fixed.TIP_THEME).replace('%s', "' || preferredTheme || '")},
    {quoted(fixed.TIP_CATEGORY).replace('%s', "' || preferredCategoryL1 || '")},
    CASE WHEN priceAffinity = 'HIGH' THEN {quoted(fixed.TIP_PREMIUM)} END,
    CASE WHEN priceAffinity = 'BULK' THEN {quoted(fixed.TIP_BULK)} END,
    CASE WHEN daysSinceLastOrder > 90 THEN
      {quoted(fixed.TIP_LAPSED).replace('%s', "' || daysSinceLastOrder || '")} END,
    CASE WHEN lifetimeOrderCount > 10 THEN {quoted(fixed.TIP_LOYAL)} END)"""

EVENT_LINE = f"""'- ' || strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y-%m-%d')
    || ': ' || eventType || ' ' || itemId
    || CASE WHEN quantity <> 0 THEN ' qty ' || quantity ELSE '' END
    || ' ($' || {plain_sql('price')} || ')' || coalesce(' via ' || recommendationId, '')"""

TIER = ("CASE priceAffinity " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TIER_WORDS.items()) + " END")

PROFILE_QUERY = f"""coalesce(nullif(concat_ws(' ', preferredTheme, preferredOccasion,
    coalesce(preferredCategoryL2, preferredCategoryL1), {TIER}), ''),
    '{fixed.DEFAULT_PROFILE_TEXT}')"""


def embed_ctes(name: str, source: str, text: str, dimensions: int = DIMENSIONS) -> str:
    """CTE `name(t, b, w)`: hashed word counts at unit length per distinct normalized text."""
    norm = f"lower(trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g')))"
    return f"""{name}_t AS (SELECT DISTINCT {norm} AS t FROM {source}),
    {name}_c AS (SELECT t, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dimensions} AS b,
        CAST(count(*) AS DOUBLE) AS n
      FROM (SELECT t, unnest(string_split(t, ' ')) AS w FROM {name}_t) WHERE w <> '' GROUP BY ALL),
    {name} AS (SELECT t, b, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY t)) AS FLOAT)
        AS DOUBLE) AS w FROM {name}_c)"""


def norm_sql(text: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g')))"


def search_ctes(out: str, index: str, queries: str, pool: int) -> str:
    """CTE `out(q, key, score, rnk)`: top `pool` keys per query text.

    `index_k(key, t)` names the keys of an index text; `index`, `queries` come
    from `embed_ctes`. Texts without a common word score 0.
    """
    return f"""{out}_d AS (SELECT q.t AS q, i.t AS t, sum(q.w * i.w) AS d
        FROM {queries} q JOIN {index} i USING (b) GROUP BY ALL),
    {out}_l AS (SELECT t, sqrt(sum(w * w)) AS l FROM {index} GROUP BY t),
    {out}_m AS (SELECT t, sqrt(sum(w * w)) AS l FROM {queries} GROUP BY t),
    {out}_s AS (SELECT m.t AS q, k.key, coalesce(round(d / m.l / l.l, 6), 0) + 0.0 AS score
        FROM {out}_m m CROSS JOIN {index}_k k JOIN {out}_l l ON l.t = k.t
        LEFT JOIN {out}_d d ON d.q = m.t AND d.t = k.t),
    {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q
        ORDER BY score DESC, key) AS rnk FROM {out}_s) WHERE rnk <= {pool})"""


def band_sql(side: int) -> str:
    return ("CASE priceAffinity " + " ".join(
        f"WHEN '{k}' THEN {b[side]}" for k, b in BANDS.items()) + " END")


BONUS = f"""round(CAST(0 AS DOUBLE)
    + CASE WHEN contains(lower(p.theme), lower(c.preferredTheme)) THEN 0.1 ELSE 0 END
    + CASE WHEN contains(lower(coalesce(p.occasion, p.theme)), lower(c.preferredOccasion))
        THEN 0.08 ELSE 0 END
    + CASE WHEN p.price > 0 AND CAST(p.price AS DOUBLE) BETWEEN {band_sql(0)} AND {band_sql(1)}
        THEN 0.05 ELSE 0 END
    + CASE WHEN c.customerType = 'BUSINESS' AND p.isBulk THEN 0.05 ELSE 0 END, 6)"""
