"""User-level jobs: ingest, index loading, search, recommendation, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoplens import fixed, schemas
from shoplens.functions import clean, metadata as md, text as tx
from shoplens.operators import recommend as rec
from shoplens.operators.dedup import dedup
from shoplens.operators.joins import enrich_vectors, valid_embeddings
from shoplens.operators.neighbors import grouped_knn, knn_join
from shoplens.operators.numbering import marked, marks
from shoplens.operators.orders import item_lists
from shoplens.operators.vectors import Embedder, embed_texts, pool_size
from shoplens.session import materialize
from shoplens.sources import files, sinks
from shoplens.sources.index_store import Index

# Per entity: typed reader, key columns, record id, text, metadata, placeholder id name.
ENTITIES = {
    "products": (clean.clean_products, ["id"], lambda: F.col("id"),
                 tx.product_text, md.product_metadata, "id"),
    "customers": (clean.clean_customers, ["userId"], lambda: F.col("userId"),
                  tx.customer_text, md.customer_metadata, "userId"),
    "interactions": (clean.clean_interactions, ["userId", "itemId", "timestamp"], tx.event_key,
                     tx.interaction_text, md.interaction_metadata, "eventKey"),
}


def requests(rows: DataFrame, entity: str) -> DataFrame:
    """Typed rows to `(recordId, text, line)`."""
    _, _, record_id, text, _, _ = ENTITIES[entity]
    body = rows.select(record_id().alias("recordId"), text().alias("text"))
    return body.withColumn("line", tx.embedding_request(F.col("recordId"), F.col("text")))


def prepare_batch(spark: SparkSession, entity: str, input_path: str, output_path: str,
                  chunk_size: int = fixed.CHUNK_SIZE) -> DataFrame:
    """CSV to deduplicated raw rows, request chunks and a manifest row, which is returned.

    The deduplicated rows are written once as the raw copy; chunks and counts
    are taken from those files, so all three agree.
    """
    read, keys, *_ = ENTITIES[entity]
    output_path = output_path.rstrip("/")
    # Typed once to files: statistics and dedup then read columns, not text.
    typed = materialize(read(files.read_entity_csv(spark, input_path)), "typed")
    sinks.write_raw_copy(dedup(typed, keys, []), f"{output_path}/raw")
    rows = spark.read.schema(typed.schema).parquet(f"{output_path}/raw")
    kept = rows.count()         # of whole files: from their footers
    chunks = sinks.write_request_chunks(requests(rows, entity), f"{output_path}/chunks",
                                        chunk_size=chunk_size)
    manifest = spark.createDataFrame(
        [(entity, kept, typed.count() - kept, chunks, chunk_size, input_path,
          output_path)],
        "dataType string, totalRecords long, duplicatesRemoved long, chunkCount int, "
        "chunkSize int, inputPath string, outputPath string")
    sinks.write_manifest(manifest, f"{output_path}/manifest")
    return manifest


def vectors_of(rows: DataFrame, entity: str) -> DataFrame:
    """Raw rows to `(key, metadata)`, the metadata within its byte cap."""
    _, _, record_id, _, to_map, _ = ENTITIES[entity]
    keyed = rows.select(record_id().alias("key"), to_map().alias("metadata"))
    return keyed.withColumn("metadata", md.metadata_byte_cap(F.col("metadata")))


def load_index(spark: SparkSession, entity: str, results_path: str, raw_path: str,
               index: Index, mode: str = "upsert", dimensions: int | None = None) -> None:
    """Model results joined with raw rows into an index, in the chosen mode.

    Of the files below `results_path` the finished ones (`.jsonl.out`) are read if
    there are any, else `.jsonl`; a path that names files is read as it is.
    """
    pattern = files.output_pattern(spark, results_path)
    results, _ = files.split_bad(
        files.read_jsonl_lenient(spark, results_path, schemas.EMBED_RESULT, pattern))
    raw = vectors_of(spark.read.parquet(raw_path), entity)
    # Read twice, for their keys and for the join, but parsed once.
    good = materialize(valid_embeddings(results), "results")
    index.write(enrich_vectors(good, raw, ENTITIES[entity][5]), mode, dimensions)


def build_vectors(rows: DataFrame, entity: str, dimensions: int,
                  embedder: Embedder | None = None) -> DataFrame:
    """Typed rows straight to vector records, for catalogs embedded in the cluster."""
    _, _, record_id, text, to_map, _ = ENTITIES[entity]
    body = rows.select(record_id().alias("key"), text().alias("_body"),
                       to_map().alias("metadata"))
    embedded = embed_texts(body, "_body", dimensions, embedder, distinct=False).drop("_body")
    return embedded.withColumn("metadata", md.metadata_byte_cap(F.col("metadata")))


def embed_rows(rows: DataFrame, entity: str, dimensions: int, embedder: Embedder | None = None) -> DataFrame:
    """Typed rows to `(key, vector)`, for searches that make the metadata of their winners only.

    Rows are dealt by key first: a small file may hold very many of them.
    """
    _, _, record_id, text, _, _ = ENTITIES[entity]
    dealt = rows.withColumn("key", record_id()).repartition("key")
    body = dealt.select("key", text().alias("_body"))
    return embed_texts(body, "_body", dimensions, embedder, distinct=False).drop("_body")


def _with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    return orders.join(item_lists(items).withColumnRenamed("orderId", "id"), "id", "left")


def _order_body() -> Column:
    return tx.order_text(tx.order_items_text(F.col("items"))).alias("_body")


def _order_map() -> Column:
    return md.order_metadata(md.order_items_json(F.col("items"))).alias("metadata")


def build_order_vectors(orders: DataFrame, items: DataFrame, dimensions: int,
                        embedder: Embedder | None = None) -> DataFrame:
    """Orders with their items straight to vector records of ten fields; orders without items stay."""
    body = _with_items(orders, items).select(F.col("id").alias("key"), _order_body(), _order_map())
    embedded = embed_texts(body, "_body", dimensions, embedder, distinct=False).drop("_body")
    return embedded.withColumn("metadata", md.metadata_byte_cap(F.col("metadata")))


def embed_orders(orders: DataFrame, items: DataFrame, dimensions: int, embedder: Embedder | None = None) -> DataFrame:
    """Orders with their items to `(key, vector)`; orders without items stay.

    Prices are not in the text: items that differ in them only may change places.
    """
    body = _with_items(orders, items.drop("price")).select(F.col("id").alias("key"), _order_body())
    return embed_texts(body, "_body", dimensions, embedder, distinct=False).drop("_body")


def order_records(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with their items to `(key, metadata)`, the metadata within its byte cap."""
    keyed = _with_items(orders, items).select(F.col("id").alias("key"), _order_map())
    return keyed.withColumn("metadata", md.metadata_byte_cap(F.col("metadata")))


#: What makes the `(key, metadata)` records, of some hits' keys at least.
Records = Callable[[DataFrame], DataFrame]


def _nearest(index: DataFrame, asked: DataFrame, k: int, dimensions: int,
             embedder: Embedder | None) -> DataFrame:
    """Nearest keys per distinct normalized text `_norm` of `asked`."""
    distinct = asked.select(F.col("_norm").alias("query_id")).distinct()
    # Written once: a filter on the vector would else go below `distinct`, so that every row is embedded.
    vectors = materialize(embed_texts(distinct, "query_id", dimensions, embedder, distinct=False), "asked")
    return materialize(knn_join(index, vectors, k, dimensions), "hits")


def _hits(index: DataFrame, asked: DataFrame, k: int, dimensions: int,
          embedder: Embedder | None, records: Records | None) -> DataFrame:
    """Nearest keys with metadata per distinct normalized text `_norm` of `asked`."""
    hits = _nearest(index, asked, k, dimensions, embedder)
    # Only records that may be among the winners are made and moved.
    known = (records(hits) if records else index).select(F.col("key").cast("string").alias("key"), "metadata").filter(
        marked(F.col("key"), marks(hits)))
    return hits.join(known.hint("merge"), "key")


def _asked(queries: DataFrame, text: str) -> DataFrame:
    return queries.select("query_id", tx.normalize_query_text(F.col(text)).alias("_norm"))


def search_keys(index: DataFrame, queries: DataFrame, k: int, dimensions: int,
                embedder: Embedder | None = None, text: str = "query") -> DataFrame:
    """`(query_id, key, score, rank)` of each query text; the index needs no metadata."""
    asked = _asked(queries, text)
    found = _nearest(index, asked, k, dimensions, embedder).withColumnRenamed("query_id", "_norm")
    return asked.join(found, "_norm").drop("_norm")


def search(index: DataFrame, queries: DataFrame, k: int, dimensions: int,
           embedder: Embedder | None = None, text: str = "query",
           records: Records | None = None) -> DataFrame:
    """`(query_id, key, score, rank, metadata)` of each query text.

    Texts are embedded and searched once per distinct normalized text. The
    metadata is joined to the winners only; it comes from `records`, or else
    from the index.
    """
    asked = _asked(queries, text)
    found = _hits(index, asked, k, dimensions, embedder, records).withColumnRenamed("query_id", "_norm")
    return asked.join(found, "_norm").drop("_norm")


_WANTED = ["customerType", "preferredTheme", "preferredOccasion", "priceAffinity"]


def _recommend(index: DataFrame, queries: DataFrame, dimensions: int, k: int, pool: int | None,
               in_stock_only: bool, embedder: Embedder | None, bands, records: Records | None) -> DataFrame:
    """Best k per query row; rows carry the text as `query` and the profile columns.

    The ranking depends on the text and four profile columns only, so it is
    done once per distinct combination and joined back to the askers.
    """
    asked = queries.withColumn("_norm", tx.normalize_query_text(F.col("query"))).drop("query")
    asked = asked.withColumn("_combo", F.md5(F.to_json(F.struct("_norm", *_WANTED))))
    combos = materialize(asked.select("_combo", "_norm", *_WANTED).distinct(), "askers")
    hits = _hits(index, combos, pool or pool_size(k), dimensions, embedder, records)
    pools = rec.candidate_pools(hits, in_stock_only).withColumnRenamed("query_id", "_norm")
    best = rec.rank_pools(combos.join(pools, "_norm"), k, bands).select("_combo", "best")
    rows = asked.drop("_norm", *_WANTED).join(best, "_combo").drop("_combo")
    return rec.unfold_best(rows)


def _with_profile(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    known = profiles.select(F.col("userId").alias("customerId"), *_WANTED)
    return queries.join(known, "customerId", "left")


def recommend_products(index: DataFrame, criteria: DataFrame, profiles: DataFrame,
                       dimensions: int, k: int = 5, pool: int | None = None,
                       in_stock_only: bool = True, embedder: Embedder | None = None,
                       bands=fixed.PRICE_BANDS, records: Records | None = None) -> DataFrame:
    """Ranked products per criteria row `(query_id, customerId?, theme, occasion, ...)`."""
    queries = criteria.select("query_id", "customerId", tx.criteria_query_text().alias("query"))
    return _recommend(index, _with_profile(queries, profiles), dimensions, k, pool,
                      in_stock_only, embedder, bands, records)


def recommend_for_customer(index: DataFrame, profiles: DataFrame, dimensions: int, k: int = 5,
                           pool: int | None = None, in_stock_only: bool = True,
                           embedder: Embedder | None = None,
                           bands=fixed.PRICE_BANDS, records: Records | None = None) -> DataFrame:
    """Ranked products for every stored profile."""
    queries = profiles.select(F.col("userId").alias("customerId"), *_WANTED,
                              tx.profile_query_text().alias("query"))
    return _recommend(index, queries, dimensions, k, pool, in_stock_only, embedder, bands, records)


def personalized_search(index: DataFrame, queries: DataFrame, profiles: DataFrame,
                        dimensions: int, k: int = 5, pool: int | None = None,
                        in_stock_only: bool = True, embedder: Embedder | None = None,
                        bands=fixed.PRICE_BANDS, records: Records | None = None) -> DataFrame:
    """Free-text queries `(query_id, customerId?, query)` ranked by profile."""
    asked = queries.select("query_id", "customerId", "query")
    return _recommend(index, _with_profile(asked, profiles), dimensions, k, pool, in_stock_only,
                      embedder, bands, records)


def recall_context(notes: DataFrame, queries: DataFrame, dimensions: int, k: int = 5,
                   embedder: Embedder | None = None) -> DataFrame:
    """Nearest stored notes of the actor who asks.

    Notes are `(namespace, noteId, text)`, queries `(query_id, actorId, query)`.
    The namespace holds the actor, and the search runs inside namespaces only;
    one with very many notes is split into blocks.
    """
    space = F.concat(F.lit("/preferences/"), F.col("actorId"), F.lit("/"))
    asked = embed_texts(queries.withColumn("bucket", space), "query", dimensions, embedder)
    stored = embed_texts(notes.filter(F.coalesce(F.col("text"), F.lit("")) != ""), "text",
                         dimensions, embedder, distinct=False)
    hits = grouped_knn(
        stored.select(_note_key().alias("key"), "vector", F.col("namespace").alias("bucket")),
        asked.select(F.col("query_id").cast("string").alias("query_id"), "vector", "bucket"), k,
        dimensions)
    # Note ids are unique inside a namespace only, so texts come back by both.
    texts = notes.select(_note_key().alias("key"), F.col("noteId").cast("string").alias("_note"), "text")
    return hits.join(texts, "key").withColumn("key", F.col("_note")).drop("_note")


def _note_key() -> Column:
    return F.concat("namespace", F.lit("\x1f"), F.col("noteId").cast("string"))


def facet_lines(facets: DataFrame, limits: dict[str, int]) -> Column:
    """The first values of some facets as one text each, a map that is the same for every row.

    All facets come from one subquery; a facet without values has no entry.
    """
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("facet"))
    few = facets.filter(F.col("rank") <= allowed)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    lines = few.groupBy("facet").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), ", ").alias("line"))
    return lines.select(F.map_from_entries(F.collect_list(F.struct("facet", "line")))).scalar()


def customer_context(profiles: DataFrame, recent: DataFrame, facets: DataFrame,
                     template: str) -> DataFrame:
    """Per customer one text: profile, tips, recent events and catalog facets.

    `recent` holds at most ten events per user and `facets` a few dozen rows,
    so the lists collected here are bounded.
    """
    lines = recent.select("userId", "recency", tx.format_event_line().alias("_line"))
    ordered = F.array_sort(F.collect_list(F.struct("recency", "_line")))
    history = lines.groupBy("userId").agg(
        F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n").alias("_history"))
    rows = profiles.join(history, "userId", "left")
    line = facet_lines(facets, {"themes": 8, "occasions": 8, "categories": 6})
    filled = tx.fill_placeholders(template, {
        "PROFILE_CONTEXT": tx.format_profile(),
        "PROFILE_TIPS": tx.profile_tips(),
        "INTERACTION_HISTORY": F.coalesce("_history", F.lit(fixed.NO_HISTORY_TEXT)),
        "THEMES": line["themes"],
        "OCCASIONS": line["occasions"],
        "CATEGORIES": line["categories"],
    })
    return rows.select("userId", filled.alias("context"))
