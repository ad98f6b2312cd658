"""Filters, re-ranking and product cards on top of nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shoplens import fixed
from shoplens.functions.metadata import let
from shoplens.operators.dedup import dedup, first_n


def in_stock(m: Column) -> Column:
    """True for unknown availability and for text containing `in stock`."""
    state = F.lower(F.coalesce(F.try_element_at(m, F.lit("availability")),
                               _stock_word(F.try_element_at(m, F.lit("inStock"))), F.lit("")))
    return (state == "") | F.contains(state, F.lit("in stock"))


def _stock_word(flag: Column) -> Column:
    return (F.when(F.lower(flag) == "false", F.lit("out of stock"))
             .when(F.lower(flag) == "true", F.lit("in stock")).otherwise(flag))


def in_stock_only(results: DataFrame) -> DataFrame:
    return results.filter(in_stock(F.col("metadata")))


def price_band(affinity: Column,
               bands: dict[str, tuple[float, float]] = fixed.PRICE_BANDS) -> tuple[Column, Column]:
    """Inclusive lower and upper price of an affinity; null when unknown."""
    def bound(side: int) -> Column:
        cases = [F.when(F.upper(affinity) == name, F.lit(float(band[side])))
                 for name, band in bands.items()]
        return F.coalesce(*cases)
    return bound(0), bound(1)


def rerank_bonus(m: Column, bands: dict[str, tuple[float, float]] = fixed.PRICE_BANDS) -> Column:
    """Sum of the profile bonuses of a candidate; profile columns lie beside it."""
    def field(name: str) -> Column:
        return F.nullif(F.try_element_at(m, F.lit(name)), F.lit(""))

    def mentions(text: Column, wanted: str) -> Column:
        word = F.nullif(F.lower(F.col(wanted)), F.lit(""))
        return F.coalesce(F.contains(F.lower(text), word), F.lit(False))

    low, high = price_band(F.col("priceAffinity"), bands)
    price = F.coalesce(field("price").try_cast("double"), F.lit(0.0))
    rules = [
        (mentions(field("theme"), "preferredTheme"), fixed.BONUS_THEME),
        (mentions(F.coalesce(field("occasion"), field("theme")), "preferredOccasion"),
         fixed.BONUS_OCCASION),
        (F.coalesce((price > 0) & price.between(low, high), F.lit(False)), fixed.BONUS_PRICE),
        (F.coalesce(F.col("customerType") == "BUSINESS", F.lit(False))
         & F.contains(F.lower(F.coalesce(field("bulkAssortments"), field("isBulk"), F.lit(""))),
                      F.lit("bulk")),
         fixed.BONUS_BULK),
    ]
    return reduce(lambda total, rule: total + F.when(rule[0], rule[1]).otherwise(0.0),
                  rules, F.lit(0.0))


def rerank_by_profile(candidates: DataFrame,
                      bands: dict[str, tuple[float, float]] = fixed.PRICE_BANDS) -> DataFrame:
    """Add `bonus` and raise `score` by it."""
    bonus = F.round(rerank_bonus(F.col("metadata"), bands), 6)
    return (candidates.withColumn("bonus", bonus)
            .withColumn("score", F.round(F.col("score") + F.col("bonus"), 6)))


def topk_per_customer(candidates: DataFrame, k: int, keys: list[str],
                      rank: str = "position") -> DataFrame:
    """Best k per customer; equal scores keep their order before the re-rank."""
    return first_n(candidates, keys, [F.desc("score"), F.asc("base_rank"), F.asc("key")],
                   k, rank=rank)


RANKING_KEYS = ["theme", "occasion", "price", "bulkAssortments", "isBulk"]


def candidate_pools(hits: DataFrame, in_stock_only: bool = True) -> DataFrame:
    """Hits with metadata to one row per query: its pool as an array of structs.

    A pool has at most as many entries as the search returned per query, and
    keeps only the metadata the re-rank reads.
    """
    rows = hits.filter(in_stock(F.col("metadata"))) if in_stock_only else hits
    few = F.map_filter("metadata", lambda name, _: name.isin(RANKING_KEYS)).alias("metadata")
    entry = F.struct("key", "score", F.col("rank").alias("base_rank"), few)
    return rows.groupBy("query_id").agg(F.collect_list(entry).alias("pool"))


def rank_pools(askers: DataFrame, k: int,
               bands: dict[str, tuple[float, float]] = fixed.PRICE_BANDS) -> DataFrame:
    """Turn the `pool` of each row into `best`, its k best entries for the profile beside it.

    Bonus, order and cut happen inside the row: candidates are not shuffled.
    """
    def entry(c: Column, bonus: Column, score: Column) -> Column:
        return F.struct((-score).alias("order"), c["base_rank"].alias("base_rank"),
                        c["key"].alias("key"), score.alias("score"), bonus.alias("bonus"))

    def ranked(c: Column) -> Column:
        return let(F.round(rerank_bonus(c["metadata"], bands), 6), lambda bonus: let(
            F.round(c["score"] + bonus, 6), lambda score: entry(c, bonus, score)))

    best = F.slice(F.array_sort(F.transform("pool", ranked)), 1, k)
    return askers.withColumn("best", best).drop("pool")


def unfold_best(rows: DataFrame) -> DataFrame:
    """One row per entry of `best`, with its position."""
    kept = [c for c in rows.columns if c != "best"]
    return rows.select(*kept, F.posexplode("best").alias("_at", "_c")).select(
        *kept, "_c.key", "_c.score", "_c.bonus", "_c.base_rank",
        (F.col("_at") + 1).alias("position"))


def product_card(key: Column, m: Column, score: Column) -> Column:
    def field(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names])
    return F.struct(
        key.alias("id"),
        F.coalesce(field("name", "title"), key).alias("title"),
        field("price").alias("price"),
        field("link").alias("link"),
        field("image").alias("image"),
        field("theme").alias("theme"),
        field("category", "categoryL2", "categoryL1").alias("category"),
        F.substring(field("description"), 1, 300).alias("description"),
        score.alias("score"),
    )


def merge_tool_results(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of result lists `(.., id, list_no, position)`; the first appearance wins."""
    both = reduce(DataFrame.unionByName, parts)
    return dedup(both, [*keys, "id"], [F.asc("list_no"), F.asc("position")])


def search_all(products: DataFrame, orders: DataFrame) -> DataFrame:
    """Two result lists side by side, tagged by their index."""
    return (products.withColumn("source", F.lit("products"))
            .unionByName(orders.withColumn("source", F.lit("orders"))))
