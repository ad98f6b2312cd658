"""Column mapping, parsing and defaults for catalog, customer and event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoplens import fixed, schemas

_WHITE = " \t\n\r\x0b\x0c\u00a0\ufeff"
_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def text_or_null(col: Column) -> Column:
    """Text trimmed of all white space, or null when blank."""
    return F.nullif(F.trim(col.cast("string"), F.lit(_WHITE)), F.lit(""))


def truthy(col: Column, data_type: T.DataType) -> Column:
    """The value, or null where it counts as missing: null, blank text, zero."""
    if isinstance(data_type, T.StringType):
        return text_or_null(col)
    if isinstance(data_type, T.NumericType):
        return F.when(col != 0, col)
    return col


def _positions(df: DataFrame, names: list[str]) -> list[int]:
    return [i for name in names for i, c in enumerate(df.columns) if c == name]


def _by_position(df: DataFrame) -> DataFrame:
    # Two spellings may differ in case only, so address columns by position.
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def map_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename to canonical fields and drop the rest; absent fields become null."""
    source = _by_position(df)
    picked = []
    for field, names in aliases.items():
        at = _positions(df, names)
        value = F.col(f"_{at[0]}") if at else F.lit(None).cast("string")
        picked.append(value.alias(field))
    return source.select(picked)


def coalesce_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Per canonical field, the first spelling that holds a value, as text."""
    source = _by_position(df)
    fields = df.schema.fields
    picked = []
    for field, names in aliases.items():
        values = [truthy(F.col(f"_{i}"), fields[i].dataType).cast("string")
                  for i in _positions(df, names)]
        picked.append(F.coalesce(*values, F.lit(None).cast("string")).alias(field))
    return source.select(picked)


def parse_price(col: Column) -> Column:
    """Digits and dots only, leading number, else 0. Signs are lost."""
    digits = F.regexp_replace(col.cast("string"), "[^0-9.]", "")
    number = F.regexp_extract(digits, r"^[0-9]*\.?[0-9]*", 0)
    return F.coalesce(number.try_cast(schemas.MONEY), F.lit(0).cast(schemas.MONEY))


def parse_boolean(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(fixed.TRUE_WORDS), F.lit(False))


def parse_flag(col: Column) -> Column:
    """True for any word that is not blank and not a plain negative."""
    word = F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))
    return ~word.isin("", "false", "no", "n", "0")


def parse_number(col: Column) -> Column:
    """The number a text starts with, as double, else null."""
    return F.regexp_extract(col.cast("string"), _NUMBER, 1).try_cast("double")


def parse_integer(col: Column) -> Column:
    return F.regexp_extract(col.cast("string"), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def _unless_blank(col: Column, parsed: Column) -> Column:
    return F.when(text_or_null(col).isNotNull(), parsed)


_PARSERS = {
    "price": parse_price, "salePrice": parse_price, "lifetimeSpend": parse_price,
    "avgOrderValue": parse_price, "inStock": parse_boolean, "isBundle": parse_boolean,
    "isOnSale": parse_boolean, "isBulk": parse_flag, "emailOptIn": parse_boolean,
    "reviewRating": parse_number,
    "accountAgeDays": lambda c: F.floor(parse_number(c)),
    "lifetimeOrderCount": lambda c: F.floor(parse_number(c)),
    "daysSinceLastOrder": lambda c: F.floor(parse_number(c)),
    "timestamp": parse_integer, "quantity": parse_integer, "eventValue": parse_number,
}


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Parse an all-text canonical table to its entity schema; blanks stay null."""
    picked = []
    for field in schema.fields:
        source = F.col(field.name)
        parser = _PARSERS.get(field.name, text_or_null)
        picked.append(_unless_blank(source, parser(source)).cast(field.dataType)
                      .alias(field.name))
    return df.select(picked)


def clean_products(df: DataFrame) -> DataFrame:
    """Typed products: rows without an id dropped, required fields defaulted."""
    rows = typed(coalesce_aliases(df, fixed.PRODUCT_ALIASES), schemas.PRODUCT)
    name = F.coalesce("name", "id")
    return rows.filter(F.col("id").isNotNull()).withColumns({
        "name": name,
        "description": F.coalesce(F.col("description"), name),
        "inStock": F.coalesce("inStock", F.lit(True)),
        "price": F.coalesce(F.col("price"), F.lit(0).cast(schemas.MONEY)),
    })


def clean_customers(df: DataFrame) -> DataFrame:
    """Typed customers: rows without a user id dropped."""
    rows = typed(coalesce_aliases(df, fixed.CUSTOMER_ALIASES), schemas.CUSTOMER)
    return rows.filter(F.col("userId").isNotNull())


def clean_interactions(df: DataFrame) -> DataFrame:
    return typed(coalesce_aliases(df, fixed.INTERACTION_ALIASES), schemas.INTERACTION)


def validate_enums(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Add `rejected`: the fields outside their closed list, or null if all pass.

    Splitting is a filter on that column, so valid and quarantined rows come
    from one scan.
    """
    broken = [F.when(~F.coalesce(F.col(c).isin(allowed), F.lit(False)), F.lit(c))
              for c, allowed in rules.items()]
    return df.withColumn("rejected", F.nullif(F.concat_ws(",", *broken), F.lit("")))
