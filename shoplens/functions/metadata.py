"""Rows to string maps and back, with the size limits of an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from shoplens import fixed
from shoplens.functions import clean
from shoplens.functions.text import plain_number


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it several times inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _string_map(pairs: dict[str, Column]) -> Column:
    """Map of the pairs whose value is not null."""
    entries = [x for name, value in pairs.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def _cut(c: Column, chars: int) -> Column:
    return F.substring(c.cast("string"), 1, chars)


def _facet(name: str) -> Column:
    return _cut(clean.text_or_null(F.col(name)), fixed.FACET_FIELD_CHARS)


def _long(name: str) -> Column:
    return F.coalesce(_cut(F.col(name), fixed.LONG_FIELD_CHARS), F.lit(""))


def product_metadata() -> Column:
    """Product fields as a map; long fields cut at 500 characters, facets at 100."""
    facets = ["categoryL1", "categoryL2", "categoryL3", "theme", "occasion", "holiday",
              "color", "material", "forWhom", "ageGroup", "gender", "brand",
              "manufacturer", "industryType", "businessUnit"]
    return _string_map({
        "name": _long("name"),
        "description": _long("description"),
        "price": plain_number(F.coalesce(F.col("price"), F.lit(0))),
        "inStock": F.coalesce(F.col("inStock"), F.lit(True)).cast("string"),
        "link": _long("productLink"),
        "image": _long("imageLink"),
        "category": _facet("categoryL1"),
        **{f: _facet(f) for f in facets},
        "salePrice": plain_number(F.when(F.col("salePrice") != 0, F.col("salePrice"))),
        "reviewRating": F.col("reviewRating"),
        "isBulk": F.when(F.col("isBulk"), F.lit("bulk")),
    })


def customer_metadata() -> Column:
    """All customer fields as a map."""
    words = ["customerType", "customerSegment", "businessUnit", "preferredCategoryL1",
             "preferredCategoryL2", "preferredOccasion", "preferredTheme", "priceAffinity",
             "discountAffinity", "region", "state"]
    return _string_map({
        "userId": F.coalesce(F.col("userId"), F.lit("")),
        **{w: _facet(w) for w in words},
        "accountAgeDays": F.col("accountAgeDays"),
        "lifetimeOrderCount": F.col("lifetimeOrderCount"),
        "lifetimeSpend": plain_number(F.col("lifetimeSpend")),
        "avgOrderValue": plain_number(F.col("avgOrderValue")),
        "daysSinceLastOrder": F.col("daysSinceLastOrder"),
        "emailOptIn": F.col("emailOptIn"),
    })


def interaction_metadata() -> Column:
    words = ["eventType", "eventValue", "quantity"]
    return _string_map({
        "userId": F.coalesce(F.col("userId"), F.lit("")),
        "itemId": F.coalesce(F.col("itemId"), F.lit("")),
        **{w: _facet(w) for w in words},
        "price": plain_number(F.col("price")),
        "timestamp": F.col("timestamp"),
        "recommendationId": _facet("recommendationId"),
    })


def order_items_json(items: Column) -> Column:
    """The items of an order as JSON text, four fields each, prices as plain numbers."""
    def one(i: Column) -> Column:
        named = F.to_json(F.struct(*[i[n].alias(n) for n in ("productId", "productName", "quantity")]))
        price = F.coalesce(plain_number(i["price"]), F.lit("null"))
        start = F.substring(named, F.lit(1), F.length(named) - 1)
        return F.concat(start, F.when(start != "{", ",").otherwise(""), F.lit('"price":'), price, F.lit("}"))
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(items, one), ","), F.lit("")), F.lit("]"))


def order_metadata(items_json: Column) -> Column:
    """Ten string fields of an order, the items as one JSON text."""
    return _string_map({
        "orderId": F.col("id"),
        "customerId": F.coalesce(F.col("customerId"), F.lit("")),
        "customerName": F.coalesce(F.col("customerName"), F.lit("")),
        "items": items_json,
        "total": plain_number(F.coalesce(F.col("total"), F.lit(0))),
        "status": F.coalesce(F.col("status"), F.lit("")),
        "orderDate": F.coalesce(F.col("orderDate").cast("string"), F.lit("")),
        "deliveryDate": F.coalesce(F.col("deliveryDate").cast("string"), F.lit("")),
        "shippingAddress": F.coalesce(F.col("shippingAddress"), F.lit("")),
        "notes": F.coalesce(F.col("notes"), F.lit("")),
    })


def filterable_bytes(m: Column, exempt: list[str] = fixed.NON_FILTERABLE_KEYS) -> Column:
    """UTF-8 size of the compact JSON of the keys that count against the cap."""
    return F.octet_length(F.to_json(F.map_filter(m, lambda k, v: ~k.isin(exempt))))


def metadata_byte_cap(m: Column, cap: int = fixed.FILTERABLE_BYTE_CAP,
                      exempt: list[str] = fixed.NON_FILTERABLE_KEYS) -> Column:
    """Trim the longest counted field, 200 characters a round, until the map fits.

    A field of n characters can be cut at n, n - 200, n - 400 ... characters, so
    the order of all cuts is that of these numbers, the first field first where
    they are equal. The pieces are measured in that order until what is left
    fits. JSON escapes single characters, so the size drops by the escaped size
    of the piece. Maps under the cap are not looked at further.
    """
    step, floor = fixed.CAP_STEP, fixed.CAP_FLOOR

    def cuts(entries: Column) -> Column:
        """(length before the cut, minus the field's place) of the first rounds, in order."""
        def of_field(e: Column, i: Column) -> Column:
            n = F.length(e["value"])
            lengths = F.when(~e["key"].isin(exempt) & (n > floor), F.slice(
                F.sequence(n, F.lit(floor + 1), F.lit(-step)), 1, fixed.CAP_ROUNDS))
            return F.coalesce(F.transform(lengths, lambda k: F.struct(k.alias("length"), (-i).alias("place"))),
                              F.array().cast("array<struct<length:int,place:int>>"))
        every = F.flatten(F.transform(entries, of_field))
        return F.slice(F.reverse(F.array_sort(every)), 1, fixed.CAP_ROUNDS)

    def piece_bytes(entries: Column, cut: Column) -> Column:
        keep = F.greatest(cut["length"] - step, F.lit(floor))
        piece = F.substring(F.get(entries, -cut["place"])["value"], keep + 1, cut["length"] - keep)
        return F.octet_length(F.to_json(F.array(piece))) - F.lit(len('[""]'))

    def needed(entries: Column, order: Column) -> Column:
        """How many of the cuts it takes."""
        start = F.struct(filterable_bytes(m, exempt).alias("bytes"), F.lit(0).alias("n"))
        return F.aggregate(order, start, lambda held, cut: F.when(held["bytes"] <= cap, held).otherwise(F.struct(
            (held["bytes"] - piece_bytes(entries, cut)).alias("bytes"), (held["n"] + 1).alias("n"))))["n"]

    def trimmed(entries: Column, made: Column) -> Column:
        def value(e: Column, i: Column) -> Column:
            rounds = F.size(F.filter(made, lambda cut: cut["place"] == -i))
            keep = F.greatest(F.length(e["value"]) - rounds * step, F.lit(floor))
            return F.struct(e["key"], F.when(rounds > 0, F.substring(e["value"], F.lit(1), keep)).otherwise(e["value"]))
        return F.map_from_entries(F.transform(entries, value))

    fitted = let(F.map_entries(m), lambda entries: let(cuts(entries), lambda order: let(
        needed(entries, order), lambda n: trimmed(entries, F.slice(order, F.lit(1), n)))))
    return F.when(filterable_bytes(m, exempt) <= cap, m).otherwise(fitted)


def typed_profile(m: Column, key: Column) -> Column:
    """String map back to a typed profile struct."""
    def field(name: str) -> Column:
        return F.try_element_at(m, F.lit(name))

    words = ["customerType", "customerSegment", "businessUnit", "preferredCategoryL1",
             "preferredCategoryL2", "preferredOccasion", "preferredTheme", "priceAffinity",
             "discountAffinity", "region", "state"]
    return F.struct(
        F.coalesce(F.nullif(field("userId"), F.lit("")), key).alias("userId"),
        *[field(w).alias(w) for w in words],
        clean.parse_integer(field("accountAgeDays")).alias("accountAgeDays"),
        clean.parse_integer(field("lifetimeOrderCount")).alias("lifetimeOrderCount"),
        clean.parse_number(field("lifetimeSpend")).alias("lifetimeSpend"),
        clean.parse_number(field("avgOrderValue")).alias("avgOrderValue"),
        clean.parse_integer(field("daysSinceLastOrder")).alias("daysSinceLastOrder"),
        F.coalesce(field("emailOptIn") == "true", F.lit(False)).alias("emailOptIn"),
    )
