"""Joins of embeddings with raw rows, and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoplens.operators.numbering import marked, marks


def valid_embeddings(results: DataFrame) -> DataFrame:
    """Result rows with an id and a vector and without an error, as `(key, vector)`."""
    return results.filter(_usable()).select(
        F.col("recordId").alias("key"), F.col("modelOutput.embedding").alias("vector"))


def rejected_embeddings(results: DataFrame) -> DataFrame:
    """The other rows with the reason they are dropped."""
    reason = (F.when(F.col("error").isNotNull(), "error")
               .when(~_filled(F.col("recordId")), "no id").otherwise("no vector"))
    return results.filter(~_usable()).select("recordId", reason.alias("reason"))


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _usable() -> Column:
    has_vector = F.coalesce(F.size("modelOutput.embedding") > 0, F.lit(False))
    return F.col("error").isNull() & _filled(F.col("recordId")) & has_vector


def _merged(raw: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Raw rows that may have a vector, for a join that sorts and merges.

    A bitmap of the keys spares the other rows their map and the shuffle. Spark
    takes a map for 68 bytes whatever it holds, and a file of few distinct
    values for its packed size: by these figures a table of any size is broadcast.
    """
    known = raw.select("key", "metadata").filter(marked(F.col("key"), marks(embeddings.select("key"))))
    return known.hint("merge")


def enrich_vectors(embeddings: DataFrame, raw: DataFrame, id_name: str = "id") -> DataFrame:
    """Attach `raw(key, metadata)`; a missing raw row leaves a placeholder map."""
    placeholder = F.create_map(F.lit(id_name), F.col("key"))
    return embeddings.join(_merged(raw, embeddings), "key", "left").withColumn(
        "metadata", F.coalesce("metadata", placeholder))


def enrich_vectors_strict(embeddings: DataFrame, raw: DataFrame) -> DataFrame:
    return embeddings.join(_merged(raw, embeddings), "key")


def missing_embeddings(raw: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Raw keys without a vector."""
    return raw.select("key").join(embeddings.select("key"), "key", "left_anti")


def orphan_embeddings(embeddings: DataFrame, raw: DataFrame) -> DataFrame:
    """Vector keys without a raw row."""
    return embeddings.select("key").join(raw.select("key"), "key", "left_anti")


def fk_check(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values of a child column absent from the parent, with their row counts.

    Children are counted per value first, so the join sees each value once and
    a value with a third of all rows costs one row.
    """
    counted = child.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    known = parent.select(F.col(parent_key).alias("value"))
    return counted.join(known, "value", "left_anti").select(
        F.lit(column).alias("column"), "value", "n_rows")


def valid_children(child: DataFrame, column: str, parent: DataFrame,
                   parent_key: str) -> DataFrame:
    """Child rows whose value exists in the parent."""
    return child.join(parent.select(F.col(parent_key).alias(column)), column, "left_semi")
