"""Catalog facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shoplens import fixed
from shoplens.functions.clean import text_or_null
from shoplens.operators.dedup import first_n

# Facet -> product column.
FACET_COLUMNS = {"themes": "theme", "occasions": "occasion", "categories": "categoryL1",
                 "colors": "color"}


def facet_counts(products: DataFrame, columns: dict[str, str] = FACET_COLUMNS,
                 limits: dict[str, int] = fixed.FACET_LIMITS) -> DataFrame:
    """Most frequent values per facet as `(facet, value, n, rank)`, exact over all rows.

    One scan: each product row becomes one row per facet, and counts combine
    before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), text_or_null(F.col(c)).alias("value"))
                      for f, c in columns.items()])
    counts = (products.select(F.inline(pairs)).filter(F.col("value").isNotNull())
              .groupBy("facet", "value").agg(F.count("*").alias("n")))
    ranked = first_n(counts, ["facet"], [F.desc("n"), F.asc("value")],
                     max(limits.values()), rank="rank")
    allowed = reduce(lambda c, kv: c.when(F.col("facet") == kv[0], kv[1]),
                     list(limits.items())[1:],
                     F.when(F.col("facet") == list(limits)[0], list(limits.values())[0]))
    return ranked.filter(F.col("rank") <= allowed)


def fallback_table(spark) -> DataFrame:
    rows = [(f, v, None, i) for f, values in fixed.FALLBACK_FACETS.items()
            for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "facet string, value string, n long, rank int")


def facet_fallback(facets: DataFrame) -> DataFrame:
    """The facets, or the built-in lists if themes, occasions and categories are all empty."""
    known = facets.filter(F.col("facet").isin("themes", "occasions", "categories"))
    is_live = known.select(F.count("*") > 0).scalar()
    live = facets.withColumn("_live", F.lit(True))
    spare = fallback_table(facets.sparkSession).withColumn("_live", F.lit(False))
    return live.unionByName(spare).filter(F.col("_live") == is_live).drop("_live")
