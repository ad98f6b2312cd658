"""Keyed deduplication with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
            rank: str | None = None) -> DataFrame:
    """First n rows of each key.

    The `row_number <= n` filter lets Spark cut each map partition to n rows
    per key before the shuffle, so a key with a third of all rows sends only n
    rows per task.
    """
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def dedup(df: DataFrame, keys: list[str], order: list[Column],
          tie: Column | None = None) -> DataFrame:
    """One row per key: the first by `order`, equal rows settled by a row hash."""
    tie = F.xxhash64(*df.columns) if tie is None else tie
    return first_n(df, keys, [*order, tie], 1)


def dedup_keep_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return dedup(df, keys, [F.col(position).asc()])


def dedup_keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return dedup(df, keys, [F.col(position).desc()])


def dedup_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and duplicates in one pass; rows combine map-side."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates_removed"))
