"""Registered queries: sources, sinks, projections, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoplens import fixed, schemas
from shoplens.functions import clean, envelope, metadata as md, privacy, text as tx
from shoplens.operators import dedup as dd, joins, orders as od
from shoplens.operators.facets import facet_counts, facet_fallback
from shoplens.plans import jobs, sql_parts as sp, tables as t
from shoplens.plans.registry import query
from shoplens.session import work_dir
from shoplens.sources import files, sinks
from shoplens.sources.index_store import Index, index_stats, upsert_union


def pairs(m: Column) -> Column:
    """A map as sorted `key=value` texts joined by `|`."""
    entries = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), "|")


def _as_double(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


# --- sources ----------------------------------------------------------------

def upper_names(aliases: dict[str, list[str]]) -> dict[str, str]:
    """Canonical field -> its upper-case input column."""
    return {field: names[-1] for field, names in aliases.items()}


def entity_csv(spark, d, entity: str, times: int = 1) -> str:
    """An entity as CSV files with upper-case headers, each row `times` times."""
    rows, aliases = {
        "customers": (t.customers, fixed.CUSTOMER_ALIASES),
        "products": (t.products, fixed.PRODUCT_ALIASES),
        "interactions": (t.interactions, fixed.INTERACTION_ALIASES)}[entity]
    path, rows = work_dir(spark, f"{entity}-csv"), rows(spark, d)
    words = {"emailOptIn": ("Y", "N"), "inStock": ("in stock", "out of stock"), "isBulk": ("Bulk", "")}
    shown = [(F.when(F.col(f), words[f][0]).otherwise(words[f][1]) if f in words else F.col(f)).alias(name)
             for f, name in upper_names(aliases).items() if f in rows.columns]
    again = F.explode(F.array_repeat(F.lit(0), times)).alias("again")
    rows.select(*shown, again).drop("again").write.option("header", True).option("escape", '"').csv(path)
    return path


def customer_csv(spark, d) -> str:
    return entity_csv(spark, d, "customers")


@query("read_entity_csv", """
    SELECT * EXCLUDE (c_custkey) REPLACE (CAST(lifetimeSpend AS DOUBLE) AS lifetimeSpend,
      CAST(avgOrderValue AS DOUBLE) AS avgOrderValue) FROM cust""")
def _read_entity_csv(spark, d):
    rows = clean.clean_customers(files.read_entity_csv(spark, customer_csv(spark, d)))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("lifetimeSpend", "avgOrderValue")})


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Raw text lines under a header line per file."""
    (lines.toDF(header).write.option("header", True).option("sep", "\u0001")
          .option("quote", "\u0000").csv(path))


@query("read_messy_csv", """
    SELECT id, name || ', "x"' AS name, CASE WHEN p_size % 4 = 0 THEN 0.0
        ELSE CAST(price AS DOUBLE) + 1000 END AS price,
      CASE WHEN p_size % 4 = 1 THEN p_size % 3 = 0 ELSE true END AS inStock
    FROM (SELECT *, CAST(substr(categoryL2, 6) AS INT) AS p_size FROM prod)""")
def _read_messy_csv(spark, d):
    path = work_dir(spark, "messy-csv")
    part = t.table(spark, d, "part")
    money = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    stock = F.when(F.col("p_size") % 3 == 0, " In Stock ").otherwise("no")
    # Short rows, quoted commas, padded and overlong rows.
    tail = (F.when(F.col("p_size") % 4 == 0, "")
             .when(F.col("p_size") % 4 == 1, F.concat(F.lit(',"$1,'), F.lpad(money, 6, "0"),
                                                      F.lit('",'), stock))
             .when(F.col("p_size") % 4 == 2, F.concat(F.lit(",1"), money, F.lit(",")))
             .otherwise(F.concat(F.lit(", USD 1"), money, F.lit(", yes ,extra"))))
    lines = part.select(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(' ,"'),
                                 F.col("p_name"), F.lit(', ""x"""'), tail).alias("value"))
    write_lines(lines, "ITEM_ID,TITLE,PRICE,AVAILABILITY", path)
    rows = clean.clean_products(files.read_messy_csv(spark, path).drop(files.BAD))
    return rows.select("id", "name", *_as_double("price"), "inStock")


@query("read_json_array", """
    SELECT o.id, o.customerId, count(i.orderId) AS n_items,
      CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS quantity
    FROM ords o LEFT JOIN items i ON i.orderId = o.id GROUP BY ALL""")
def _read_json_array(spark, d):
    path = work_dir(spark, "orders-json")
    lists = od.item_lists(t.items(spark, d))
    rows = t.orders(spark, d).join(lists, F.col("id") == F.col("orderId"), "left")
    # A thousand neighbouring orders per array, each array in a file of its own.
    arrays = (rows.groupBy(F.floor(F.col("id").cast("long") / 1000).alias("b"))
              .agg(F.to_json(F.collect_list(F.struct("id", "customerId", "items"))).alias("value")))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    orders = files.read_json_array(spark, path, schemas.ORDER)
    count = F.coalesce(F.aggregate(F.transform("items", lambda i: i["quantity"]),
                                   F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
    # An order with very many lines comes as several objects.
    return orders.groupBy("id", "customerId").agg(
        F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("n_items"),
        F.sum(count).alias("quantity"))


def results(spark, d) -> DataFrame:
    """Result lines written to files and read back."""
    path = work_dir(spark, "results")
    t.result_lines(spark, d).write.text(path)
    return files.read_jsonl_lenient(spark, path, schemas.EMBED_RESULT)


@query("read_jsonl_lenient", """
    SELECT CASE WHEN label NOT IN (6, 8) THEN key END AS recordId, label = 8 AS is_bad,
      CASE WHEN label = 9 THEN '400' END AS errorCode,
      CASE WHEN label < 7 THEN len(v) ELSE NULL END AS n_dims FROM vecs""")
def _read_jsonl_lenient(spark, d):
    rows = results(spark, d)
    return rows.select(
        F.when(F.col(files.BAD).isNull(), F.col("recordId")).alias("recordId"),
        F.col(files.BAD).isNotNull().alias("is_bad"),
        F.col("error.errorCode").alias("errorCode"),
        F.when(F.col(files.BAD).isNull(), F.nullif(F.size("modelOutput.embedding"), F.lit(-1)))
         .cast("long").alias("n_dims"))


CHUNK = 500


def _chunks(spark, d) -> tuple[str, int]:
    path = work_dir(spark, "chunks")
    n = sinks.write_request_chunks(jobs.requests(t.products(spark, d), "products"), path,
                                   chunk_size=CHUNK)
    return path, n


@query("discover_files", f"""
    SELECT greatest(1, CAST(ceil(count(*) / {CHUNK}) AS BIGINT)) AS n_files,
      true AS all_named FROM prod""")
def _discover_files(spark, d):
    path, _ = _chunks(spark, d)
    found = files.discover_chunks(spark, path)
    return found.agg(F.count("*").alias("n_files"),
                     F.bool_and(F.col("length") > 0).alias("all_named"))


def built_index(spark, d) -> Index:
    index = Index(spark, work_dir(spark, "index"), "products")
    index.replace(t.product_index(spark, d), t.DIMENSIONS)
    return index


@query("scan_index", f"SELECT key, {sp.pairs_sql(sp.PRODUCT_META)} AS metadata "
                     "FROM vecs JOIN prod ON key = id")
def _scan_index(spark, d):
    return built_index(spark, d).scan().select("key", pairs(F.col("metadata")).alias("metadata"))


@query("get_by_key", "SELECT key, name, len(v) AS n_dims FROM vecs JOIN prod ON key = id "
                     "WHERE key = '42'")
def _get_by_key(spark, d):
    return built_index(spark, d).get("42").select(
        "key", F.col("metadata")["name"].alias("name"),
        F.size("vector").cast("long").alias("n_dims"))


# --- sinks ------------------------------------------------------------------

@query("write_request_chunks", f"SELECT id AS recordId, {sp.PRODUCT_TEXT} AS inputText, "
                               "1024 AS dimensions, true AS normalized FROM prod")
def _write_request_chunks(spark, d):
    path, _ = _chunks(spark, d)
    shape = ("recordId string, modelInput struct<inputText string, dimensions int, "
             "normalize boolean>")
    rows = spark.read.schema(shape).json(path)
    return rows.select("recordId", "modelInput.inputText", "modelInput.dimensions",
                       F.col("modelInput.normalize").alias("normalized"))


@query("write_raw_copy", "SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(salePrice AS DOUBLE) "
                         "AS salePrice) FROM prod")
def _write_raw_copy(spark, d):
    path = work_dir(spark, "raw")
    rows = t.products(spark, d)
    sinks.write_raw_copy(rows, path)
    empty = ("material", "forWhom", "gender", "industryType", "businessUnit", "reviewRating")
    return spark.read.parquet(path).withColumns({
        c: F.col(c).cast("double") for c in ("price", "salePrice")}).drop(*empty)


@query("write_manifest", f"""
    SELECT 'products' AS dataType, count(*) AS totalRecords, count(*) AS duplicatesRemoved,
      CAST(ceil(count(*) / {CHUNK}) AS INT) AS chunkCount, {CHUNK} AS chunkSize, true AS reads_input,
      true AS names_output FROM prod""")
def _write_manifest(spark, d):
    source, out = entity_csv(spark, d, "products", 2), work_dir(spark, "manifest")
    jobs.prepare_batch(spark, "products", source, out, CHUNK)
    return spark.read.parquet(f"{out}/manifest").select(
        "dataType", "totalRecords", "duplicatesRemoved", "chunkCount", "chunkSize",
        (F.col("inputPath") == source).alias("reads_input"), (F.col("outputPath") == out).alias("names_output"))


def changes(spark, d) -> DataFrame:
    """New records: labels 0-2 again with another name, label 3 under new keys."""
    rows = t.vectors(spark, d)
    key = F.when(F.col("label") == 3, F.concat(F.lit("new-"), "key")).otherwise(F.col("key"))
    return rows.filter("label <= 3").select(
        key.alias("key"), "vector",
        F.create_map(F.lit("name"), F.concat(F.lit("changed "), "key")).alias("metadata"))


_OLD = "SELECT key, name, false AS changed FROM vecs JOIN prod ON key = id"
_NEW = ("SELECT CASE WHEN label = 3 THEN 'new-' || key ELSE key END AS key, "
        "'changed ' || key AS name, true AS changed FROM vecs WHERE label <= 3")


def _named(rows: DataFrame) -> DataFrame:
    name = F.col("metadata")["name"]
    return rows.select("key", name.alias("name"), F.startswith(name, F.lit("changed "))
                       .alias("changed"))


@query("index_replace", _NEW)
def _index_replace(spark, d):
    index = built_index(spark, d)
    index.write(changes(spark, d), "replace")
    return _named(index.scan())


@query("index_upsert", f"{_NEW} UNION ALL ({_OLD} WHERE label > 2)")
def _index_upsert(spark, d):
    index = built_index(spark, d)
    index.write(changes(spark, d), "upsert")
    return _named(index.scan())


@query("index_append_new", f"""
    WITH o AS ({_OLD}), n AS ({_NEW}), a AS (SELECT * FROM n ANTI JOIN o USING (key))
    SELECT *, (SELECT count(*) FROM n) - (SELECT count(*) FROM a) AS skipped,
      (SELECT count(*) FROM a) AS added FROM (FROM o UNION ALL FROM a)""")
def _index_append_new(spark, d):
    index = built_index(spark, d)
    index.write(changes(spark, d), "append")
    row = index.current()
    return _named(index.scan()).withColumns({"skipped": F.lit(row.skipped).cast("long"),
                                             "added": F.lit(row.added).cast("long")})


@query("upsert_union", f"{_NEW} UNION ALL ({_OLD} WHERE label > 2)")
def _upsert_union(spark, d):
    return _named(upsert_union(t.product_index(spark, d), changes(spark, d)))


@query("write_vector_file", """SELECT 'products-index' AS indexName, 64 AS dimensions,
    'cosine' AS distanceMetric, key, len(v) AS n_dims FROM vecs JOIN prod ON key = id""")
def _write_vector_file(spark, d):
    path = work_dir(spark, "vector-file")
    sinks.write_vector_file(t.product_index(spark, d), path, "products-index", t.DIMENSIONS)
    shape = ("indexName string, dimensions int, distanceMetric string, key string, "
             "vector array<float>, metadata map<string,string>")
    rows = spark.read.schema(shape).json(path)
    return rows.select("indexName", "dimensions", "distanceMetric", "key",
                       F.size("vector").cast("long").alias("n_dims"))


@query("write_csv_like_input", "SELECT doc_id, text, source FROM documents")
def _write_csv(spark, d):
    path = work_dir(spark, "csv-out")
    sinks.write_csv_like_input(t.table(spark, d, "documents"), path, ["doc_id", "text", "source"])
    rows = files.read_messy_csv(spark, path, multi_line=True)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


# --- projections ------------------------------------------------------------

_RAW_FIELDS = {f: f"'{i}-' || p_partkey || '-' || p_size % {i + 2}"
               for i, f in enumerate(fixed.PRODUCT_ALIASES)}
_RAW_CUSTOMER = {f: f"'{i}-' || c_custkey" for i, f in enumerate(fixed.CUSTOMER_ALIASES)}


def _listed(fields: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in fields.items())


@query("map_columns", f"SELECT {_listed(_RAW_FIELDS)} FROM part")
def _map_columns(spark, d):
    """All 33 product fields, from columns in another order beside foreign ones."""
    names = upper_names(fixed.PRODUCT_ALIASES)
    raw = t.table(spark, d, "part").selectExpr(
        "p_name OTHER",
        *[f"{_RAW_FIELDS[f]} {names[f]}" for f in reversed(names)])
    return clean.map_columns(raw, fixed.PRODUCT_ALIASES)


@query("map_customer_columns", f"SELECT {_listed(_RAW_CUSTOMER)} FROM customer")
def _map_customer_columns(spark, d):
    names = upper_names(fixed.CUSTOMER_ALIASES)
    raw = t.table(spark, d, "customer").selectExpr(
        "c_name OTHER", *[f"{_RAW_CUSTOMER[f]} {names[f]}" for f in reversed(names)])
    return clean.map_columns(raw, fixed.CUSTOMER_ALIASES)


@query("coalesce_aliases", """
    SELECT CAST(user_id AS VARCHAR) AS userId, json_extract_string(props, '$.k') AS itemId,
      CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS "timestamp",
      CASE WHEN event_id % 4 < 2 THEN event_type ELSE 'second ' || event_type END AS eventType,
      CASE WHEN event_id % 2 = 1 THEN '1' END AS eventValue,
      CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 5 AS VARCHAR)
           WHEN event_id % 7 <> 0 THEN CAST(event_id % 7 AS VARCHAR) END AS quantity,
      CASE WHEN event_id % 6 > 0 THEN '$' || event_id % 6 END AS price,
      CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN event_type
        END AS recommendationId FROM events""")
def _coalesce_aliases(spark, d):
    raw = t.table(spark, d, "events").selectExpr(
        "cast(user_id as string) USER_ID", "get_json_object(props, '$.k') itemId",
        "unix_seconds(cast(ts as timestamp)) TIMESTAMP",
        "case when event_id % 4 < 2 then event_type else '\t' end eventType",
        "concat('second ', event_type) EVENT_TYPE", "event_id % 2 eventValue",
        "case when event_id % 6 > 0 then concat(' $', event_id % 6) else '' end PRICE",
        "event_id % 5 quantity", "event_id % 7 QUANTITY",
        "case when event_id % 3 = 0 then 'A' else ' ' end recommendationId",
        "case when event_id % 3 = 1 then event_type end RECOMMENDATION_ID")
    return clean.coalesce_aliases(raw, fixed.INTERACTION_ALIASES)


@query("parse_price", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price FROM lineitem""")
def _parse_price(spark, d):
    money = F.concat(F.lit("USD $"), F.col("l_extendedprice").cast("decimal(12,2)"), F.lit(" -"))
    return t.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        clean.parse_price(money).cast("double").alias("price"))


@query("parse_boolean", """
    SELECT p_partkey, p_size % 7 IN (0, 1, 2, 3) AS flag FROM part""")
def _parse_boolean(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in (" TRUE ", "In Stock", "y", "1", "no",
                                                     "out of stock", None)]),
                        F.col("p_size") % 7 + 1)
    return t.table(spark, d, "part").select("p_partkey", clean.parse_boolean(word).alias("flag"))


@query("parse_number", """
    SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_linenumber <> 3 THEN -l_quantity END AS number FROM lineitem""")
def _parse_number(spark, d):
    word = F.when(F.col("l_linenumber") == 3, "n/a").otherwise(
        F.concat(F.lit(" -"), F.col("l_quantity").cast("string"), F.lit(" pieces")))
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                               clean.parse_number(word).alias("number"))


@query("clean_and_default", """
    SELECT CAST(p_partkey AS VARCHAR) AS id,
      CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS name,
      CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS description,
      CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE p_retailprice END AS price, true AS inStock
    FROM part WHERE p_size % 9 <> 0""")
def _clean_and_default(spark, d):
    raw = t.table(spark, d, "part").selectExpr(
        "case when p_size % 9 = 0 then '  ' else concat(' ', p_partkey) end ITEM_ID",
        "case when p_size % 3 = 0 then '' else p_name end TITLE",
        "case when p_size % 2 = 0 then 'ask us' else cast(p_retailprice as string) end PRICE")
    return clean.clean_products(raw).select("id", "name", "description", *_as_double("price"),
                                            "inStock")


@query("product_text", f"SELECT id, {sp.PRODUCT_TEXT} AS text FROM prod")
def _product_text(spark, d):
    return t.products(spark, d).select("id", tx.product_text().alias("text"))


@query("product_text_bulk", f"""SELECT id, concat_ws('. ', 'Product: ' || name, 'Category: ' || categoryL1,
    '> ' || categoryL2, 'Theme: ' || theme, 'Occasion: ' || occasion, 'Description: ' || description,
    'Price: $' || {t.plain_sql('price')}, 'Color: ' || color,
    CASE WHEN inStock THEN 'In stock' ELSE 'Out of stock' END, 'Brand: ' || brand) AS text FROM prod""")
def _product_text_bulk(spark, d):
    return t.products(spark, d).select("id", tx.product_text(rich=False).alias("text"))


@query("customer_text", f"SELECT userId, {sp.CUSTOMER_TEXT} AS text FROM cust")
def _customer_text(spark, d):
    return t.customers(spark, d).select("userId", tx.customer_text().alias("text"))


@query("interaction_text", f"SELECT eventId, {sp.INTERACTION_TEXT} AS text FROM inter")
def _interaction_text(spark, d):
    return t.interactions(spark, d).select("eventId", tx.interaction_text().alias("text"))


@query("order_text", f"""
    SELECT id, 'Order ' || id || ' by ' || customerName || '. Items: ' || names
      || '. Total: $' || {t.plain_sql('total')} || '. Status: ' || status || '. Ordered: '
      || CAST(orderDate AS VARCHAR) || '. Delivery: ' || CAST(deliveryDate AS VARCHAR)
      || '. Address: . Notes: ' || notes AS text
    FROM ords JOIN (SELECT orderId, string_agg(productName || ' (x' || quantity || ')', ', '
        ORDER BY itemNo, productId, productName, quantity, price) AS names
      FROM items GROUP BY orderId) ON orderId = id""")
def _order_text(spark, d):
    lists = od.item_lists(t.items(spark, d))
    rows = t.orders(spark, d).join(lists, F.col("id") == F.col("orderId"))
    return rows.select("id", tx.order_text(tx.order_items_text(F.col("items"))).alias("text"))


@query("event_key", f"SELECT eventId, {sp.EVENT_KEY} AS event_key FROM inter")
def _event_key(spark, d):
    return t.interactions(spark, d).select("eventId", tx.event_key().alias("event_key"))


@query("embedding_request", f"""
    SELECT eventId, '{{"recordId":"' || {sp.EVENT_KEY} || '","modelInput":{{"inputText":"'
      || {sp.INTERACTION_TEXT} || '","dimensions":1024,"normalize":true}}}}' AS line
    FROM inter""")
def _embedding_request(spark, d):
    return t.interactions(spark, d).select(
        "eventId", tx.embedding_request(tx.event_key(), tx.interaction_text()).alias("line"))


@query("product_metadata", f"SELECT id, {sp.pairs_sql(sp.PRODUCT_META)} AS metadata FROM prod")
def _product_metadata(spark, d):
    return t.products(spark, d).select("id", pairs(md.product_metadata()).alias("metadata"))


@query("customer_metadata",
       f"SELECT userId, {sp.pairs_sql(sp.CUSTOMER_META)} AS metadata FROM cust")
def _customer_metadata(spark, d):
    return t.customers(spark, d).select("userId", pairs(md.customer_metadata()).alias("metadata"))


@query("interaction_metadata",
       f"SELECT eventId, {sp.pairs_sql(sp.INTERACTION_META)} AS metadata FROM inter")
def _interaction_metadata(spark, d):
    return t.interactions(spark, d).select(
        "eventId", pairs(md.interaction_metadata()).alias("metadata"))


@query("order_metadata", f"""SELECT id, {sp.pairs_sql(sp.ORDER_META)} AS metadata FROM full_orders
    WHERE js <> '[]'""")
def _order_metadata(spark, d):
    lists = od.item_lists(t.items(spark, d))
    rows = t.orders(spark, d).join(lists, F.col("id") == F.col("orderId"))
    return rows.select("id", pairs(md.order_metadata(md.order_items_json(F.col("items")))).alias("metadata"))


@query("metadata_byte_cap", f"""
    WITH RECURSIVE r AS (
      SELECT doc_id, text AS body, replace(text, ' ', '') AS copy, source, 0 AS i
      FROM documents
      UNION ALL
      SELECT doc_id,
        CASE WHEN length(body) >= length(copy) THEN substr(body, 1, greatest(length(body) - 200,
          20)) ELSE body END,
        CASE WHEN length(body) < length(copy) THEN substr(copy, 1, greatest(length(copy) - 200,
          20)) ELSE copy END, source, i + 1
      FROM r WHERE i < 20 AND greatest(length(body), length(copy)) > 20
        AND strlen(CAST(to_json({{'body': body, 'copy': copy, 'source': source}}) AS VARCHAR))
          > {fixed.FILTERABLE_BYTE_CAP})
    SELECT doc_id, max_by(body, i) AS body, max_by(copy, i) AS copy, max_by(source, i) AS source
    FROM r GROUP BY doc_id""")
def _metadata_byte_cap(spark, d):
    rows = t.table(spark, d, "documents")
    full = F.create_map(F.lit("body"), F.col("text"), F.lit("copy"),
                        F.replace(F.col("text"), F.lit(" "), F.lit("")),
                        F.lit("source"), F.col("source"), F.lit("description"), F.col("text"))
    capped = rows.select("doc_id", md.metadata_byte_cap(full).alias("m"))
    return capped.select("doc_id", *[F.col("m")[k].alias(k) for k in ("body", "copy", "source")])


@query("typed_profile", """
    SELECT userId, customerType, preferredTheme, accountAgeDays, lifetimeOrderCount,
      CAST(lifetimeSpend AS DOUBLE) AS lifetimeSpend, CAST(avgOrderValue AS DOUBLE) AS
      avgOrderValue, daysSinceLastOrder, emailOptIn FROM cust""")
def _typed_profile(spark, d):
    rows = t.customers(spark, d).select("userId", md.customer_metadata().alias("m"))
    profile = rows.select(md.typed_profile(F.col("m"), F.col("userId")).alias("p"))
    return profile.select([f"p.{c}" for c in (
        "userId", "customerType", "preferredTheme", "accountAgeDays", "lifetimeOrderCount",
        "lifetimeSpend", "avgOrderValue", "daysSinceLastOrder", "emailOptIn")])


_CRITERIA = """
    SELECT CAST(p_partkey AS VARCHAR) AS query_id, split_part(p_name, ' ', 2) AS theme,
      CASE WHEN p_size % 2 = 0 THEN 'Event ' || (p_size % 7) END AS occasion,
      CASE WHEN p_size % 3 = 0 THEN p_type END AS category, split_part(p_name, ' ', 1) AS color,
      CASE WHEN p_size < 10 THEN 'kids' END AS ageGroup, p_size % 4 * 10 AS guestCount,
      CASE p_size % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' WHEN 3 THEN 'bulk'
        END AS budget, CASE WHEN p_size > 45 THEN p_brand END AS keywords,
      CAST(p_partkey % 100 AS VARCHAR) AS customerId
    FROM part"""
CRITERIA_QUERY = f"""coalesce(nullif(concat_ws(' ', theme, occasion, category,
    color || ' colored', 'for ' || ageGroup, CASE WHEN guestCount <> 0 THEN
    guestCount || ' guests' END, {sp.TIER.replace('priceAffinity', 'upper(budget)')},
    keywords), ''), '{fixed.DEFAULT_CRITERIA_TEXT}')"""


def criteria(spark, d) -> DataFrame:
    """One structured request per part."""
    return t.table(spark, d, "part").selectExpr(
        "cast(p_partkey as string) query_id", "split_part(p_name, ' ', 2) theme",
        "case when p_size % 2 = 0 then concat('Event ', p_size % 7) end occasion",
        "case when p_size % 3 = 0 then p_type end category",
        "split_part(p_name, ' ', 1) color", "case when p_size < 10 then 'kids' end ageGroup",
        "p_size % 4 * 10 guestCount",
        """case p_size % 5 when 0 then 'low' when 1 then 'mid' when 2 then 'high'
           when 3 then 'bulk' end budget""",
        "case when p_size > 45 then p_brand end keywords",
        "cast(p_partkey % 100 as string) customerId")


CRITERIA_SQL = _CRITERIA


@query("criteria_query_text",
       f"SELECT query_id, {CRITERIA_QUERY} AS query FROM ({_CRITERIA})")
def _criteria_query_text(spark, d):
    return criteria(spark, d).select("query_id", tx.criteria_query_text().alias("query"))


@query("profile_query_text", f"SELECT userId, {sp.PROFILE_QUERY} AS query FROM cust")
def _profile_query_text(spark, d):
    return t.customers(spark, d).select("userId", tx.profile_query_text().alias("query"))


@query("normalize_query_text", f"SELECT doc_id, {sp.norm_sql('text')} AS text FROM documents")
def _normalize_query_text(spark, d):
    return t.table(spark, d, "documents").select(
        "doc_id", tx.normalize_query_text(F.col("text")).alias("text"))


@query("profile_tips", f"SELECT userId, {sp.PROFILE_TIPS} AS tips FROM cust")
def _profile_tips(spark, d):
    return t.customers(spark, d).select("userId", tx.profile_tips().alias("tips"))


@query("format_profile", f"SELECT userId, {sp.FORMAT_PROFILE} AS profile FROM cust")
def _format_profile(spark, d):
    return t.customers(spark, d).select("userId", tx.format_profile().alias("profile"))


@query("format_event_line", f"SELECT eventId, {sp.EVENT_LINE} AS line FROM inter")
def _format_event_line(spark, d):
    return t.interactions(spark, d).select("eventId", tx.format_event_line().alias("line"))


@query("extract_event_fields", "SELECT conv_id, turn, upper(role) AS role, text FROM conversations")
def _extract_event_fields(spark, d):
    rows = t.table(spark, d, "conversations")
    # Half of the contents are plain texts, half hold the text in a field.
    nested = F.to_json(F.array(F.struct(F.struct(
        F.upper("role").alias("role"), F.struct(F.col("text")).alias("content"))
        .alias("conversational"))))
    flat = F.to_json(F.array(F.struct(F.struct(
        F.upper("role").alias("role"), F.col("text").alias("content")).alias("conversational"))))
    payload = rows.select("conv_id", "turn",
                          F.when(F.col("turn") % 2 == 0, nested).otherwise(flat).alias("payload"))
    role, text = envelope.extract_event_fields(F.col("payload"))
    return payload.select("conv_id", "turn", role.alias("role"), text.alias("text"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TAGGED = "raw"
for _tag in fixed.SCRATCHPAD_TAGS:
    _TAGGED = f"regexp_replace({_TAGGED}, '(?is)<{_tag}>.*?</{_tag}>', '', 'g')"
_MARK = sp.quoted(fixed.BLOCK_MARKER)


@query("classify_responses", rf"""
    WITH c AS (SELECT *, {_STRIP.format(_TAGGED)} AS cleaned,
        contains(raw, {_MARK}) AS blocked,
        {_STRIP.format(f"split_part(raw, {_MARK}, 1)")} <> '' AS mid FROM responses),
    k AS (SELECT *, {_STRIP.format(r"regexp_extract(cleaned, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1)")}
        AS c1, cleaned AS c2, regexp_extract(cleaned, '(?s)\{{.*\}}', 0) AS c3 FROM c),
    j AS (SELECT *, CASE WHEN c1 LIKE '{{%' THEN TRY_CAST(c1 AS JSON) END AS j1,
        CASE WHEN c2 LIKE '{{%' THEN TRY_CAST(c2 AS JSON) END AS j2,
        CASE WHEN c3 LIKE '{{%' THEN TRY_CAST(c3 AS JSON) END AS j3 FROM k),
    h AS (SELECT *, CASE
        WHEN j1->>'$.type' IN ('answer','followup','blocked') AND json_type(j1, '$.message') = 'VARCHAR' THEN j1
        WHEN j2->>'$.type' IN ('answer','followup','blocked') AND json_type(j2, '$.message') = 'VARCHAR' THEN j2
        WHEN j3->>'$.type' IN ('answer','followup','blocked') AND json_type(j3, '$.message') = 'VARCHAR' THEN j3
      END AS hit FROM j)
    SELECT conv_id, turn, CASE WHEN blocked THEN 'blocked' ELSE coalesce(hit->>'$.type', 'answer')
        END AS type,
      CASE WHEN blocked AND mid THEN {sp.quoted(fixed.BLOCK_MID_TEXT)}
           WHEN blocked THEN {sp.quoted(fixed.BLOCK_FULL_TEXT)}
           ELSE coalesce(hit->>'$.message', nullif(cleaned, ''), raw) END AS message,
      CASE WHEN NOT blocked AND hit->>'$.type' = 'answer' THEN concat_ws('|', hit->>'$.recommendations[0].id',
        hit->>'$.recommendations[0].title', hit->>'$.recommendations[0].score') ELSE '' END AS recommendations,
      CASE WHEN NOT blocked AND hit->>'$.type' = 'followup' THEN concat_ws('|', hit->>'$.followups[0].id',
        hit->>'$.followups[0].label', hit->>'$.followups[0].options[1].value') ELSE '' END AS followups,
      CASE WHEN NOT blocked THEN concat_ws('|', hit->>'$.meta.toolsCalled[0]', hit->>'$.meta.toolsCalled[1]')
        ELSE '' END AS tools_called,
      CASE WHEN blocked AND mid THEN 'mid-stream' WHEN blocked THEN 'full-block' END
        AS blocked_reason FROM h""")
def _classify_responses(spark, d):
    def shown(column: str, one) -> Column:
        return F.concat_ws("|", F.transform(column, one))

    return envelope.classify_responses(t.responses(spark, d)).drop("raw").withColumns({
        "recommendations": shown("recommendations", lambda r: F.concat_ws("|", r["id"], r["title"], r["score"].cast("string"))),
        "followups": shown("followups", lambda q: F.concat_ws("|", q["id"], q["label"], F.get(q["options"], F.lit(1))["value"])),
        "tools_called": F.concat_ws("|", "tools_called")})


# --- embedding results and raw rows -----------------------------------------

@query("valid_embeddings", "SELECT key, len(v) AS n_dims FROM vecs WHERE label < 6")
def _valid_embeddings(spark, d):
    good, _ = files.split_bad(results(spark, d))
    return joins.valid_embeddings(good).select("key",
                                               F.size("vector").cast("long").alias("n_dims"))


@query("rejected_embeddings", """
    SELECT CASE WHEN label <> 6 THEN key END AS recordId, CASE label WHEN 9 THEN 'error'
      WHEN 7 THEN 'no vector' ELSE 'no id' END AS reason FROM vecs WHERE label IN (6, 7, 9)""")
def _rejected_embeddings(spark, d):
    """Result rows that are left out, with the reason."""
    good, _ = files.split_bad(results(spark, d))
    return joins.rejected_embeddings(good)


@query("quarantined_lines", "SELECT count(*) AS lines, true AS cut_off FROM vecs WHERE label = 8")
def _quarantined_lines(spark, d):
    """Result lines that do not parse, kept as they came."""
    _, bad = files.split_bad(results(spark, d))
    return bad.agg(F.count("*").alias("lines"), F.bool_and(F.length(files.BAD) == 40).alias("cut_off"))


def _raw(spark, d) -> DataFrame:
    """Raw rows of the parts in stock; the others have a vector but no raw row."""
    return jobs.vectors_of(t.products(spark, d).filter("inStock"), "products")


_RAW = "(SELECT * FROM prod WHERE inStock)"


@query("enrich_vectors", f"""
    SELECT key, CASE WHEN r.id IS NULL THEN 'id=' || key ELSE {sp.pairs_sql(sp.PRODUCT_META)} END
      AS metadata FROM vecs LEFT JOIN {_RAW} r ON key = r.id""")
def _enrich_vectors(spark, d):
    rows = joins.enrich_vectors(t.vectors(spark, d), _raw(spark, d))
    return rows.select("key", pairs(F.col("metadata")).alias("metadata"))


@query("enrich_vectors_strict", f"SELECT key, name FROM vecs JOIN {_RAW} ON key = id")
def _enrich_vectors_strict(spark, d):
    rows = joins.enrich_vectors_strict(t.vectors(spark, d), _raw(spark, d))
    return rows.select("key", F.col("metadata")["name"].alias("name"))


@query("missing_embeddings", "SELECT id AS key FROM prod ANTI JOIN vecs ON key = id")
def _missing_embeddings(spark, d):
    raw = t.products(spark, d).select(F.col("id").alias("key"))
    return joins.missing_embeddings(raw, t.vectors(spark, d))


@query("orphan_embeddings", f"SELECT key FROM vecs ANTI JOIN {_RAW} r ON key = r.id")
def _orphan_embeddings(spark, d):
    return joins.orphan_embeddings(t.vectors(spark, d), _raw(spark, d))


# --- facets, index figures, dedup -------------------------------------------

_FACETS = """SELECT facet, value, n, rank FROM (SELECT facet, value, count(*) AS n,
    row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS rank,
    any_value(lim) AS lim FROM (
      SELECT 'themes' AS facet, theme AS value, 12 AS lim FROM prod
      UNION ALL SELECT 'occasions', occasion, 10 FROM prod
      UNION ALL SELECT 'categories', categoryL1, 8 FROM prod
      UNION ALL SELECT 'colors', color, 10 FROM prod) GROUP BY facet, value) WHERE rank <= lim"""
FACETS_SQL = _FACETS


@query("facet_counts", f"SELECT facet, value, n, CAST(rank AS INT) AS rank FROM ({_FACETS})")
def _facet_counts(spark, d):
    return facet_counts(t.products(spark, d))


@query("facet_fallback", "SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', {sp.quoted(v)}, {i})" for f, values in fixed.FALLBACK_FACETS.items()
    for i, v in enumerate(values, 1)) + ") AS x(facet, value, rank)")
def _facet_fallback(spark, d):
    # Nothing is known of themes, occasions and categories here, only colors.
    bare = t.products(spark, d).withColumns({
        c: F.lit(" ") for c in ("theme", "occasion", "categoryL1")})
    return facet_fallback(facet_counts(bare)).select("facet", "value", "rank")


@query("index_stats", "SELECT count(*) AS n_rows, min(len(v)) AS min_dim, max(len(v)) AS max_dim "
                      "FROM vecs")
def _index_stats(spark, d):
    return index_stats(t.vectors(spark, d)).select(
        "n_rows", F.col("min_dim").cast("long").alias("min_dim"),
        F.col("max_dim").cast("long").alias("max_dim"))


@query("dedup_stats", """
    SELECT count(*) AS total, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct,
      count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates_removed FROM lineitem""")
def _dedup_stats(spark, d):
    return dd.dedup_stats(t.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dedup_by_key", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
    WHERE rn = 1""")
def _dedup_by_key(spark, d):
    rows = dd.dedup(t.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                    [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"),
                     F.asc("l_extendedprice")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("dedup_keep_first", "SELECT user_id, props, min(event_id) AS event_id FROM events "
                           "GROUP BY user_id, props")
def _dedup_keep_first(spark, d):
    return dd.dedup_keep_first(t.table(spark, d, "events"), ["user_id", "props"],
                               "event_id").select("user_id", "props", "event_id")


@query("dedup_keep_last", "SELECT user_id, props, max(event_id) AS event_id FROM events "
                          "GROUP BY user_id, props")
def _dedup_keep_last(spark, d):
    return dd.dedup_keep_last(t.table(spark, d, "events"), ["user_id", "props"],
                              "event_id").select("user_id", "props", "event_id")


# --- composite --------------------------------------------------------------

_PREPARED = {"customers": ("cust", "userId", sp.CUSTOMER_TEXT), "products": ("prod", "id", sp.PRODUCT_TEXT),
             "interactions": ("(SELECT DISTINCT * EXCLUDE (eventId) FROM inter)", sp.EVENT_KEY, sp.INTERACTION_TEXT)}


@query("prepare_batch", " UNION ALL ".join(f"""
    SELECT '{name}' AS dataType, CAST({key} AS VARCHAR) AS recordId, {text} AS inputText,
      (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table})) AS totalRecords,
      (SELECT count(*) FROM {"inter" if name == "interactions" else table}) * 2
        - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table})) AS duplicatesRemoved,
      CAST(ceil((SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table})) / {CHUNK}) AS INT) AS chunkCount
    FROM {table}""" for name, (table, key, text) in _PREPARED.items() if name != "interactions") + f"""
    UNION ALL SELECT 'interactions', k, NULL, count(*) OVER (), (SELECT count(*) FROM inter) * 2 - count(*) OVER (),
      CAST(ceil(count(*) OVER () / {CHUNK}) AS INT) FROM (SELECT DISTINCT {sp.EVENT_KEY} AS k FROM inter)""")
def _prepare_batch(spark, d):
    """Every request line of three entities whose rows all come twice, with the figures of its run.

    Which of several events with one key stays is settled by a row hash, so their text is left out.
    """
    shape = "recordId string, modelInput struct<inputText string>"
    out = None
    for entity in _PREPARED:
        folder = work_dir(spark, "prepared")
        run = jobs.prepare_batch(spark, entity, entity_csv(spark, d, entity, 2), folder, CHUNK).first()
        text = F.col("modelInput.inputText") if entity != "interactions" else F.lit(None).cast("string")
        lines = spark.read.schema(shape).json(f"{folder}/chunks").select(
            F.lit(run.dataType).alias("dataType"), "recordId", text.alias("inputText"),
            F.lit(run.totalRecords).cast("long").alias("totalRecords"),
            F.lit(run.duplicatesRemoved).cast("long").alias("duplicatesRemoved"),
            F.lit(run.chunkCount).cast("int").alias("chunkCount"))
        out = lines if out is None else out.unionByName(lines)
    return out


@query("load_index", f"""
    SELECT key, CASE WHEN id IS NULL THEN 'id=' || key ELSE {sp.pairs_sql(sp.PRODUCT_META)} END
      AS metadata, len(v) AS n_dims FROM vecs LEFT JOIN prod ON key = id WHERE label < 6""")
def _load_index(spark, d):
    lines, raw = work_dir(spark, "results"), work_dir(spark, "raw")
    t.result_lines(spark, d).write.text(lines)
    sinks.write_raw_copy(t.products(spark, d), raw)
    index = Index(spark, work_dir(spark, "index"), "products")
    jobs.load_index(spark, "products", lines, raw, index, "upsert", t.DIMENSIONS)
    return index.scan().select("key", pairs(F.col("metadata")).alias("metadata"),
                               F.size("vector").cast("long").alias("n_dims"))


# --- governance -------------------------------------------------------------

@query("hash_ids", "SELECT userId, 'CUST-' || upper(substr(sha256(userId || 'salt'), 1, 16)) "
                   "AS hashed FROM cust")
def _hash_ids(spark, d):
    return t.customers(spark, d).select(
        "userId", privacy.hash_ids(F.col("userId"), "salt").alias("hashed"))


@query("generalize_columns", f"""
    SELECT userId, [{', '.join(sp.quoted(x) for x in fixed.REGION_LABELS)}][
        CAST('0x' || substr(md5(userId), 1, 8) AS BIGINT) % 8 + 1] AS region, customerType,
      CASE WHEN businessUnit IS NOT NULL THEN '' END AS businessUnit FROM cust""")
def _generalize_columns(spark, d):
    return privacy.generalize_columns(t.customers(spark, d)).select(
        "userId", "region", "customerType", "businessUnit")


_RULES = [(r"(?i)example\.com", "example.org"), (r"(?i)mail[0-9]", "post"), ("the", "THE")]


@query("scrub_text", r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'example\.com',
      'example.org', 'gi'), 'mail[0-9]', 'post', 'gi'), 'the', 'THE', 'g') AS text, lang, source
    FROM documents""")
def _scrub_text(spark, d):
    return privacy.scrub_text(t.table(spark, d, "documents"), _RULES).drop("n_chars")


@query("placeholder_urls", """
    SELECT id, 'https://example.com/products/' || id AS link,
      'https://example.com/images/' || id || '.jpg' AS image FROM prod""")
def _placeholder_urls(spark, d):
    return t.products(spark, d).select(
        "id", privacy.placeholder_url(F.col("id")).alias("link"),
        privacy.placeholder_url(F.col("id"), "images", ".jpg").alias("image"))


@query("pii_mask", rf"""
    WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{privacy.CARD}')) AS c
        FROM documents),
    digits AS (SELECT doc_id, c, reverse(regexp_replace(c, '[^0-9]', '', 'g')) AS n FROM found),
    places AS (SELECT doc_id, c, n, unnest(range(1, length(n) + 1)) AS i FROM
        (SELECT DISTINCT * FROM digits)),
    sums AS (SELECT doc_id, c, sum(CASE WHEN i % 2 = 1 THEN CAST(n[i] AS INT)
        WHEN CAST(n[i] AS INT) * 2 > 9 THEN CAST(n[i] AS INT) * 2 - 9
        ELSE CAST(n[i] AS INT) * 2 END) AS s FROM places GROUP BY doc_id, c),
    cards AS (SELECT DISTINCT doc_id FROM sums WHERE s % 10 = 0)
    SELECT doc_id, regexp_replace(regexp_replace(text, '{privacy.EMAIL}', '{{EMAIL}}', 'g'),
        '{privacy.PHONE}', '{{PHONE}}', 'g') AS masked,
      doc_id IN (SELECT doc_id FROM cards) AS has_card,
      regexp_matches(text, '{privacy.CVV}') AS has_cvv,
      regexp_matches(text, '{privacy.EXPIRY}') AS has_expiry,
      regexp_matches(text, '{privacy.SSN}') AS has_ssn,
      regexp_matches(text, '{privacy.BANK_ACCOUNT}') AS has_bank,
      regexp_matches(text, '{privacy.ROUTING}') AS has_routing FROM documents""")
def _pii_mask(spark, d):
    return privacy.pii_mask(t.table(spark, d, "documents")).select(
        "doc_id", "masked", "has_card", "has_cvv", "has_expiry", "has_ssn", "has_bank",
        "has_routing")


_TOPICS = {"Places": ["in the", "of  That"], "Acts": ["is", "des", "und-die"], "Accents": ["ación", "für die"],
           "None": ["election"]}
_WORDS = r"' ' || regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g') || ' '"


def _plain(phrase: str) -> str:
    return " ".join(phrase.lower().replace("-", " ").split())



@query("denied_topic_flags", "SELECT doc_id, concat_ws(',', " + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains({_WORDS}, ' {_plain(p)} ')" for p in phrases)
    + f" THEN '{name}' END" for name, phrases in _TOPICS.items()) + ") AS topics FROM documents")
def _denied_topic_flags(spark, d):
    return privacy.denied_topic_flags(t.table(spark, d, "documents"), _TOPICS).select(
        "doc_id", "topics")
