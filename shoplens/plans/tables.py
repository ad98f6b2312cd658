"""The given star-schema tables as retail entities.

Each entity has a Spark form and, for checking, the same rows as SQL. Prices of
the parts lie between 900 and 1000, so price bands are set for them here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

BANDS = {"LOW": (0, 930), "MID": (920, 960), "HIGH": (950, 2000), "BULK": (0, 2000)}
AS_OF = 1706745600                 # 2024-02-01, after the last event
AS_OF_DATE = "2001-09-01"          # after the last order
BASE_MS = 1704067200000            # 2024-01-01, start of the first conversation
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Spark forms ------------------------------------------------------------

def products(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "cast(p_partkey as string) id", "p_name name", "p_brand brand",
        "concat(p_brand, ' ', p_name) description",
        "cast(p_retailprice as decimal(12,2)) price",
        "case when p_size % 5 = 0 then cast(p_retailprice - 100 as decimal(12,2)) end salePrice",
        "p_type categoryL1", "concat('Size ', p_size) categoryL2",
        "case when p_size > 40 then 'Large' end categoryL3",
        "split_part(p_name, ' ', 2) theme", "split_part(p_name, ' ', 1) color",
        "concat('Event ', p_size % 7) occasion",
        "case when p_size % 6 = 0 then 'Winter' end holiday",
        "case when p_size < 10 then 'Kids' end ageGroup",
        "cast(null as string) material", "cast(null as string) forWhom",
        "cast(null as string) gender", "concat('Maker ', p_brand) manufacturer",
        "cast(null as string) industryType", "cast(null as string) businessUnit",
        "concat('https://example.com/products/', p_partkey) productLink",
        "concat('https://example.com/images/', p_partkey, '.jpg') imageLink",
        "cast(null as double) reviewRating",
        "p_size % 10 <> 0 inStock", "p_size % 8 = 0 isBulk")


def customers(spark, d) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = (table(spark, d, "customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    business = "c_mktsegment in ('MACHINERY', 'AUTOMOBILE')"
    return rows.selectExpr(
        "cast(c_custkey as string) userId",
        f"case when {business} then 'BUSINESS' else 'CONSUMER' end customerType",
        f"""case when {business} then 'B2B' when c_acctbal >= 6000 then 'PREMIUM'
            when c_acctbal >= 2000 then 'STANDARD' else 'BUDGET' end customerSegment""",
        "case when c_custkey % 3 = 0 then 'Unit A' end businessUnit",
        """element_at(array('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD', 'LARGE'),
            cast(c_custkey % 6 + 1 as int)) preferredCategoryL1""",
        """case when c_custkey % 4 = 0 then concat('Size ', c_custkey % 50 + 1) end
            preferredCategoryL2""",
        "case when c_custkey % 5 > 0 then concat('Event ', c_custkey % 7) end preferredOccasion",
        """element_at(array('ring', 'bolt', 'gear', 'gizmo', 'anvil', 'plate', 'rod', 'widget',
            null), cast(c_custkey % 9 + 1 as int)) preferredTheme""",
        f"""case when {business} then 'BULK' when c_acctbal >= 6000 then 'HIGH'
            when c_acctbal >= 2000 then 'MID' else 'LOW' end priceAffinity""",
        "case when c_custkey % 2 = 0 then 'LOW' else 'HIGH' end discountAffinity",
        "r_name region", "n_name state",
        "c_custkey % 1000 accountAgeDays", "c_custkey % 30 lifetimeOrderCount",
        "cast(abs(c_acctbal) as decimal(12,2)) lifetimeSpend",
        "cast(floor(abs(c_acctbal) / 10) as decimal(12,2)) avgOrderValue",
        "c_custkey % 200 daysSinceLastOrder", "c_custkey % 2 = 0 emailOptIn")


def interactions(spark, d) -> DataFrame:
    return interactions_of(table(spark, d, "events"))


def interactions_of(events: DataFrame) -> DataFrame:
    kind = "case when event_type = 'click' then 'add_to_cart' else event_type end"
    epoch = "unix_seconds(cast(ts as timestamp))"
    return events.selectExpr(
        "event_id eventId", "cast(ts as timestamp) ts", "cast(user_id as string) userId",
        "get_json_object(props, '$.k') itemId", f"{epoch} timestamp", f"{kind} eventType",
        """case event_type when 'view' then 1.0D when 'click' then 2.0D when 'purchase' then 5.0D
            end eventValue""",
        "case when event_type in ('click', 'purchase') then event_id % 4 else 0L end quantity",
        "cast(value as decimal(12,2)) price",
        "case when event_id % 3 = 0 then 'Trending Now' end recommendationId")


def order_keys(spark, d) -> DataFrame:
    """Orders with the columns that need no other table."""
    return table(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) id", "cast(o_custkey as string) customerId",
        "cast(o_totalprice as decimal(12,2)) total", "cast(o_orderdate as date) orderDate")


def item_keys(spark, d) -> DataFrame:
    """Order and product of every item."""
    return table(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey as string) orderId", "cast(l_partkey as string) productId")


def orders(spark, d) -> DataFrame:
    customer = table(spark, d, "customer").selectExpr("c_custkey", "c_name")
    return (table(spark, d, "orders").join(customer, F.expr("o_custkey = c_custkey"), "left")
            .selectExpr(
        "cast(o_orderkey as string) id", "cast(o_custkey as string) customerId",
        "c_name customerName", "cast(o_totalprice as decimal(12,2)) total",
        """case o_orderstatus when 'F' then 'Delivered' when 'O' then 'Processing'
            else 'Pending' end status""",
        "cast(o_orderdate as date) orderDate",
        "date_add(cast(o_orderdate as date), 7) deliveryDate",
        "cast(null as string) shippingAddress", "o_orderpriority notes"))


def items(spark, d) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey", "p_name", "p_retailprice")
    return (table(spark, d, "lineitem").join(part, F.expr("l_partkey = p_partkey"))
            .selectExpr("cast(l_orderkey as string) orderId", "l_linenumber itemNo",
                        "cast(l_partkey as string) productId", "p_name productName",
                        "cast(l_quantity as bigint) quantity",
                        "cast(p_retailprice as decimal(12,2)) price"))


def messages(spark, d) -> DataFrame:
    return table(spark, d, "conversations").selectExpr(
        "concat('actor-', conv_id % 20) actorId", "concat('session-', conv_id) sessionId",
        "upper(role) role", "text content", "turn",
        f"{BASE_MS} + conv_id * 7200000 + turn * 1500000 timestamp")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr(
        "cast(vec_id as string) key", "embedding vector", "label")


def product_index(spark, d) -> DataFrame:
    """Vectors of the parts with their metadata."""
    from shoplens.functions.metadata import product_metadata
    from shoplens.operators.joins import enrich_vectors_strict
    rows = products(spark, d).select(F.col("id").alias("key"),
                                     product_metadata().alias("metadata"))
    return enrich_vectors_strict(vectors(spark, d).select("key", "vector"), rows)


def result_lines(spark, d) -> DataFrame:
    """Embedding results as JSON lines, some of them failed, empty or cut off."""
    return table(spark, d, "embeddings").selectExpr("""
        case when label = 9 then to_json(named_struct('recordId', cast(vec_id as string), 'error',
                 named_struct('errorCode', '400', 'errorMessage', 'too long')))
             when label = 8 then substr(to_json(named_struct('recordId', cast(vec_id as string),
                 'modelOutput', named_struct('embedding', embedding))), 1, 40)
             when label = 7 then to_json(named_struct('recordId', cast(vec_id as string)))
             when label = 6 then to_json(named_struct('modelOutput',
                 named_struct('embedding', embedding)))
             else to_json(named_struct('recordId', cast(vec_id as string),
                 'modelOutput', named_struct('embedding', embedding))) end value""")


def log_lines(spark, d) -> DataFrame:
    """Operational log lines, one per event."""
    return table(spark, d, "events").selectExpr(
        "cast(ts as timestamp) ts", "cast(user_id % 5 as string) process", """case event_type
        when 'view' then '[envelope] tool=search_products'
        when 'click' then case when event_id % 2 = 0 then '[envelope] tool=recommend_products'
            when event_id % 10 = 1 then '[catalog-facets] index empty, using fallback'
            else '[catalog-facets] Loaded from 1000 vectors' end
        when 'error' then case event_id % 3 when 0 then '[prompts] Loaded 12 sections'
            when 1 then '[prompt-loader] DDB read failed (Timeout): falling back'
            else '[guardrail] Output blocked' end
        when 'signup' then concat('[embed-cache] hits=', event_id % 2500, ' misses=', event_id % 2500 * (1 + user_id % 5))
        else concat('request completed status=',
            case when event_id % 50 = 0 then 503 else 200 end,
            ' responseTime=', cast(floor(value * 100) as bigint)) end line""")


def jobs(spark, d) -> DataFrame:
    """Submitted chunk jobs: each order is a chunk of the run of its customer and type."""
    return table(spark, d, "orders").selectExpr(
        "concat('run-', o_custkey) run", "concat('type-', o_custkey % 7) dataType",
        "cast(o_custkey as bigint) startedAt",
        "concat('part-', lpad(cast(o_orderkey as string), 9, '0')) inputKey",
        """case o_orderkey % 40 when 0 then 'Failed' when 1 then 'InProgress'
            else 'Completed' end status""")


def chunks(spark, d) -> DataFrame:
    """All chunks of the runs; those of urgent pending orders are not submitted yet."""
    return table(spark, d, "orders").selectExpr(
        "concat('run-', o_custkey) run",
        "concat('part-', lpad(cast(o_orderkey as string), 9, '0')) inputKey",
        "o_orderpriority <> '1-URGENT' or o_orderstatus <> 'P' submitted")


def responses(spark, d) -> DataFrame:
    """Raw chat responses: the assistant and user texts in the shapes models emit."""
    body = "replace(replace(replace(text, '\\\\', ' '), '\"', ' '), '\\n', ' ')"
    envelope = f"""concat('{{"type":"', case when turn % 4 = 0 then 'followup'
        when turn % 4 = 1 then 'answer' else 'unknown' end, '","message":"', {body},
        '","recommendations":[{{"id":"p', conv_id, '","title":"Item ', turn, '","score":0.5}}],',
        '"followups":[{{"id":"q', turn, '","label":"Which?","options":[{{"label":"A","value":"a"}},',
        '{{"label":"B","value":"b', conv_id, '"}}]}}],"meta":{{"toolsCalled":["search_products","t', turn, '"]}}}}')"""
    return table(spark, d, "conversations").selectExpr(
        "conv_id", "turn", f"""case (conv_id + turn) % 8
        when 0 then {envelope}
        when 1 then concat('```json\\n', {envelope}, '\\n```')
        when 2 then concat('Here you go: ', {envelope}, ' Enjoy!')
        when 3 then concat('<thinking>', text, '</thinking>', {envelope})
        when 4 then "I'm sorry, I can't provide that information."
        when 5 then concat(text, "I'm sorry, I can't provide that information.")
        when 6 then concat('<scratchpad>', text, '</scratchpad>')
        else text end raw""")


# --- SQL forms --------------------------------------------------------------

_PLAIN = r"regexp_replace(CAST(CAST({} AS DECIMAL(12,2)) AS VARCHAR), '\.?0+$', '')"


def plain_sql(expression: str) -> str:
    return _PLAIN.format(expression)


SQL = {
    "prod": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS brand,
          p_brand || ' ' || p_name AS description,
          CAST(p_retailprice AS DECIMAL(12,2)) AS price,
          CASE WHEN p_size % 5 = 0 THEN CAST(p_retailprice - 100 AS DECIMAL(12,2)) END
            AS salePrice,
          p_type AS categoryL1, 'Size ' || p_size AS categoryL2,
          CASE WHEN p_size > 40 THEN 'Large' END AS categoryL3,
          split_part(p_name, ' ', 2) AS theme, split_part(p_name, ' ', 1) AS color,
          'Event ' || (p_size % 7) AS occasion,
          CASE WHEN p_size % 6 = 0 THEN 'Winter' END AS holiday,
          CASE WHEN p_size < 10 THEN 'Kids' END AS ageGroup,
          'Maker ' || p_brand AS manufacturer,
          'https://example.com/products/' || p_partkey AS productLink,
          'https://example.com/images/' || p_partkey || '.jpg' AS imageLink,
          p_size % 10 <> 0 AS inStock, p_size % 8 = 0 AS isBulk
        FROM part""",
    "cust": """
        SELECT CAST(c_custkey AS VARCHAR) AS userId, c_custkey,
          CASE WHEN c_mktsegment IN ('MACHINERY','AUTOMOBILE') THEN 'BUSINESS'
               ELSE 'CONSUMER' END AS customerType,
          CASE WHEN c_mktsegment IN ('MACHINERY','AUTOMOBILE') THEN 'B2B'
               WHEN c_acctbal >= 6000 THEN 'PREMIUM' WHEN c_acctbal >= 2000 THEN 'STANDARD'
               ELSE 'BUDGET' END AS customerSegment,
          CASE WHEN c_custkey % 3 = 0 THEN 'Unit A' END AS businessUnit,
          ['ECONOMY','SMALL','MEDIUM','PROMO','STANDARD','LARGE'][c_custkey % 6 + 1]
            AS preferredCategoryL1,
          CASE WHEN c_custkey % 4 = 0 THEN 'Size ' || (c_custkey % 50 + 1) END
            AS preferredCategoryL2,
          CASE WHEN c_custkey % 5 > 0 THEN 'Event ' || (c_custkey % 7) END AS preferredOccasion,
          ['ring','bolt','gear','gizmo','anvil','plate','rod','widget',NULL][c_custkey % 9 + 1]
            AS preferredTheme,
          CASE WHEN c_mktsegment IN ('MACHINERY','AUTOMOBILE') THEN 'BULK'
               WHEN c_acctbal >= 6000 THEN 'HIGH' WHEN c_acctbal >= 2000 THEN 'MID'
               ELSE 'LOW' END AS priceAffinity,
          CASE WHEN c_custkey % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS discountAffinity,
          r_name AS region, n_name AS state,
          c_custkey % 1000 AS accountAgeDays, c_custkey % 30 AS lifetimeOrderCount,
          CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS lifetimeSpend,
          CAST(floor(abs(c_acctbal) / 10) AS DECIMAL(12,2)) AS avgOrderValue,
          c_custkey % 200 AS daysSinceLastOrder, c_custkey % 2 = 0 AS emailOptIn
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "inter": """
        SELECT event_id AS eventId, ts, CAST(user_id AS VARCHAR) AS userId,
          json_extract_string(props, '$.k') AS itemId,
          epoch_us(ts) // 1000000 AS "timestamp",
          CASE WHEN event_type = 'click' THEN 'add_to_cart' ELSE event_type END AS eventType,
          CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 5.0
            END AS eventValue,
          CASE WHEN event_type IN ('click','purchase') THEN event_id % 4 ELSE 0 END AS quantity,
          CAST(value AS DECIMAL(12,2)) AS price,
          CASE WHEN event_id % 3 = 0 THEN 'Trending Now' END AS recommendationId
        FROM events""",
    "ords": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customerId,
          c_name AS customerName, CAST(o_totalprice AS DECIMAL(12,2)) AS total,
          CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Processing'
               ELSE 'Pending' END AS status,
          CAST(o_orderdate AS DATE) AS orderDate,
          CAST(o_orderdate AS DATE) + 7 AS deliveryDate, o_orderpriority AS notes
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "items": """
        SELECT CAST(l_orderkey AS VARCHAR) AS orderId, l_linenumber AS itemNo,
          CAST(l_partkey AS VARCHAR) AS productId, p_name AS productName,
          CAST(l_quantity AS BIGINT) AS quantity, CAST(p_retailprice AS DECIMAL(12,2)) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "full_orders": f"""
        SELECT o.*, coalesce(names, '') AS names, '[' || coalesce(js, '') || ']' AS js FROM ords o
        LEFT JOIN (SELECT orderId, string_agg(productName || ' (x' || quantity || ')', ', '
            ORDER BY itemNo, productId, productName, quantity, price) AS names,
          string_agg('{{"productId":"' || productId || '","productName":"' || productName
            || '","quantity":' || quantity || ',"price":' || {plain_sql('price')} || '}}', ','
            ORDER BY itemNo, productId, productName, quantity, price) AS js
          FROM items GROUP BY orderId) ON orderId = id""",
    "msgs": f"""
        SELECT 'actor-' || (conv_id % 20) AS actorId, 'session-' || conv_id AS sessionId,
          upper(role) AS role, text AS content, turn,
          {BASE_MS} + conv_id * 7200000 + turn * 1500000 AS "timestamp"
        FROM conversations""",
    "vecs": """
        SELECT CAST(vec_id AS VARCHAR) AS key, CAST(embedding AS DOUBLE[]) AS v, label
        FROM embeddings""",
    "logs": """
        SELECT ts, CAST(user_id % 5 AS VARCHAR) AS process, CASE event_type
          WHEN 'view' THEN '[envelope] tool=search_products'
          WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN '[envelope] tool=recommend_products'
            WHEN event_id % 10 = 1 THEN '[catalog-facets] index empty, using fallback'
            ELSE '[catalog-facets] Loaded from 1000 vectors' END
          WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN '[prompts] Loaded 12 sections'
            WHEN 1 THEN '[prompt-loader] DDB read failed (Timeout): falling back'
            ELSE '[guardrail] Output blocked' END
          WHEN 'signup' THEN '[embed-cache] hits=' || (event_id % 2500) || ' misses=' || (event_id % 2500 * (1 + user_id % 5))
          ELSE 'request completed status=' || CASE WHEN event_id % 50 = 0 THEN 503 ELSE 200 END
            || ' responseTime=' || CAST(floor(value * 100) AS BIGINT) END AS line
        FROM events""",
    "jobs": """
        SELECT 'run-' || o_custkey AS run, 'type-' || (o_custkey % 7) AS dataType,
          o_custkey AS startedAt, 'part-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS inputKey,
          CASE o_orderkey % 40 WHEN 0 THEN 'Failed' WHEN 1 THEN 'InProgress'
            ELSE 'Completed' END AS status,
          o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'P' AS submitted
        FROM orders""",
    "responses": r"""
        SELECT conv_id, turn, CASE (conv_id + turn) % 8
          WHEN 0 THEN env
          WHEN 1 THEN '```json' || chr(10) || env || chr(10) || '```'
          WHEN 2 THEN 'Here you go: ' || env || ' Enjoy!'
          WHEN 3 THEN '<thinking>' || text || '</thinking>' || env
          WHEN 4 THEN 'I''m sorry, I can''t provide that information.'
          WHEN 5 THEN text || 'I''m sorry, I can''t provide that information.'
          WHEN 6 THEN '<scratchpad>' || text || '</scratchpad>'
          ELSE text END AS raw
        FROM (SELECT *, '{"type":"' || CASE WHEN turn % 4 = 0 THEN 'followup'
            WHEN turn % 4 = 1 THEN 'answer' ELSE 'unknown' END || '","message":"'
            || replace(replace(replace(text, chr(92), ' '), '"', ' '), chr(10), ' ')
            || '","recommendations":[{"id":"p' || conv_id || '","title":"Item ' || turn || '","score":0.5}],'
            || '"followups":[{"id":"q' || turn || '","label":"Which?","options":[{"label":"A","value":"a"},'
            || '{"label":"B","value":"b' || conv_id || '"}]}],"meta":{"toolsCalled":["search_products","t' || turn
            || '"]}}' AS env FROM conversations)""",
}


def oracle(body: str) -> str:
    """Prefix a query with the entity definitions it names."""
    used, text = [], body
    while more := [n for n in SQL if n not in used and re.search(rf"\b{n}\b", text)]:
        used += more
        text = " ".join(SQL[n] for n in more if n == "full_orders")
    used.sort(key=list(SQL).index)
    if not used:
        return body
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:]}"
    return f"WITH {heads} {body}"
