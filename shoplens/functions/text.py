"""Embedding texts, query texts and readable lines, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shoplens import fixed

SEPARATOR = ". "


def col(name: str) -> Column:
    return F.col(name)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def plain_number(c: Column) -> Column:
    """Two-decimal money in its shortest form: 30.00 -> 30, 12.50 -> 12.5."""
    return F.regexp_replace(c.try_cast("decimal(38,2)").cast("string"), r"\.?0+$", "")


def money(c: Column) -> Column:
    return c.try_cast("decimal(38,2)").cast("string")


def part(prefix: str, value: Column) -> Column:
    """`prefix` + value, or null when the value is missing or blank."""
    return F.concat(F.lit(prefix), blank_to_null(value.cast("string")))


def always(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(value.cast("string"), F.lit("")))


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def product_text(rich: bool = True) -> Column:
    """One product as a sentence; `rich` adds the fields of the detailed schema."""
    stock = F.when(col("inStock"), F.lit("In stock")).when(~col("inStock"), F.lit("Out of stock"))
    extra = (lambda c: c) if rich else (lambda c: F.lit(None).cast("string"))
    return F.concat_ws(
        SEPARATOR,
        always("Product: ", col("name")),
        part("Category: ", col("categoryL1")),
        part("> ", col("categoryL2")),
        extra(part("> ", col("categoryL3"))),
        part("Theme: ", col("theme")),
        part("Occasion: ", col("occasion")),
        extra(part("Holiday: ", col("holiday"))),
        always("Description: ", col("description")),
        always("Price: $", plain_number(F.coalesce(col("price"), F.lit(0)))),
        extra(part("Sale Price: $", plain_number(nonzero(col("salePrice"))))),
        part("Color: ", col("color")),
        extra(part("Material: ", col("material"))),
        extra(part("For: ", col("forWhom"))),
        extra(part("Age Group: ", col("ageGroup"))),
        stock,
        part("Brand: ", col("brand")),
        extra(part("Manufacturer: ", col("manufacturer"))),
    )


def _location() -> Column:
    return F.concat(F.lit("Location: "), blank_to_null(col("region")), F.lit(", "),
                    blank_to_null(col("state")))


def customer_text(rich: bool = True) -> Column:
    """One customer as a sentence; zero counts print only in the rich form."""
    extra = (lambda c: c) if rich else (lambda c: F.lit(None).cast("string"))
    count = (lambda c: c) if rich else nonzero
    return F.concat_ws(
        SEPARATOR,
        always("Customer: ", col("userId")),
        part("Type: ", col("customerType")),
        part("Segment: ", col("customerSegment")),
        part("Preferred Category: ", col("preferredCategoryL1")),
        part("Preferred Theme: ", col("preferredTheme")),
        extra(part("Preferred Occasion: ", col("preferredOccasion"))),
        part("Price Affinity: ", col("priceAffinity")),
        extra(part("Discount Affinity: ", col("discountAffinity"))),
        _location(),
        part("Orders: ", count(col("lifetimeOrderCount"))),
        part("Lifetime Spend: $", plain_number(count(col("lifetimeSpend")))),
        extra(part("Avg Order: $", plain_number(col("avgOrderValue")))),
        extra(part("Days Since Last Order: ", col("daysSinceLastOrder"))),
    )


def interaction_text() -> Column:
    """One event as a sentence; zero quantity and zero price are left out."""
    return F.concat_ws(
        SEPARATOR,
        F.concat(F.lit("User "), F.coalesce(col("userId"), F.lit("")), F.lit(" performed "),
                 F.coalesce(blank_to_null(col("eventType")), F.lit("event")),
                 F.lit(" on item "), F.coalesce(col("itemId"), F.lit(""))),
        part("at timestamp ", nonzero(col("timestamp"))),
        part("quantity ", nonzero(col("quantity"))),
        part("price $", plain_number(nonzero(col("price")))),
        part("via ", F.trim(col("recommendationId"))),
    )


def order_items_text(items: Column) -> Column:
    return F.array_join(
        F.transform(items, lambda i: F.concat(i["productName"], F.lit(" (x"),
                                              i["quantity"].cast("string"), F.lit(")"))),
        ", ")


def order_text(items_text: Column) -> Column:
    """One order as a sentence, given the text of its items."""
    return F.concat(
        F.lit("Order "), col("id"), F.lit(" by "), F.coalesce(col("customerName"), F.lit("")),
        F.lit(". Items: "), F.coalesce(items_text, F.lit("")),
        F.lit(". Total: $"), plain_number(F.coalesce(col("total"), F.lit(0))),
        F.lit(". Status: "), F.coalesce(col("status"), F.lit("")),
        F.lit(". Ordered: "), F.coalesce(col("orderDate").cast("string"), F.lit("")),
        F.lit(". Delivery: "), F.coalesce(col("deliveryDate").cast("string"), F.lit("")),
        F.lit(". Address: "), F.coalesce(col("shippingAddress"), F.lit("")),
        F.lit(". Notes: "), F.coalesce(col("notes"), F.lit("")),
    )


def event_key() -> Column:
    """Composite id `user_item_timestamp`; missing parts stay as empty text."""
    return F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit(""))
                              for c in ("userId", "itemId", "timestamp")])


def embedding_request(record_id: Column, text: Column,
                      dimensions: int = fixed.EMBED_DIMENSIONS) -> Column:
    """One request line as JSON."""
    return F.to_json(F.struct(
        record_id.cast("string").alias("recordId"),
        F.struct(text.alias("inputText"), F.lit(dimensions).alias("dimensions"),
                 F.lit(True).alias("normalize")).alias("modelInput"),
    ))


def _tier_words(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in fixed.TIER_WORDS.items() for x in pair])
    return F.try_element_at(words, F.upper(c))


def criteria_query_text() -> Column:
    """Structured criteria columns to one query text."""
    text = F.concat_ws(
        " ",
        blank_to_null(col("theme")), blank_to_null(col("occasion")),
        blank_to_null(col("category")),
        F.concat(blank_to_null(col("color")), F.lit(" colored")),
        part("for ", col("ageGroup")),
        F.concat(nonzero(col("guestCount")).cast("string"), F.lit(" guests")),
        _tier_words(col("budget")),
        blank_to_null(col("keywords")),
    )
    return F.coalesce(blank_to_null(F.trim(text)), F.lit(fixed.DEFAULT_CRITERIA_TEXT))


def profile_query_text() -> Column:
    """Stored preferences to one query text; the finer category wins."""
    words = F.when(col("priceAffinity").isin(list(fixed.TIER_WORDS)),
                   _tier_words(col("priceAffinity")))
    text = F.concat_ws(
        " ",
        blank_to_null(col("preferredTheme")), blank_to_null(col("preferredOccasion")),
        F.coalesce(blank_to_null(col("preferredCategoryL2")),
                   blank_to_null(col("preferredCategoryL1"))),
        words,
    )
    return F.coalesce(blank_to_null(F.trim(text)), F.lit(fixed.DEFAULT_PROFILE_TEXT))


def normalize_query_text(c: Column) -> Column:
    squeezed = F.regexp_replace(c, r"\s+", " ")
    return F.lower(F.trim(squeezed))


def profile_tips() -> Column:
    def filled(template: str, value: Column) -> Column:
        before, after = template.split("%s")
        return F.concat(F.lit(before), value, F.lit(after))

    return F.concat_ws(
        "\n",
        filled(fixed.TIP_THEME, blank_to_null(col("preferredTheme"))),
        filled(fixed.TIP_CATEGORY, blank_to_null(col("preferredCategoryL1"))),
        F.when(col("priceAffinity") == "HIGH", F.lit(fixed.TIP_PREMIUM)),
        F.when(col("priceAffinity") == "BULK", F.lit(fixed.TIP_BULK)),
        F.when(col("daysSinceLastOrder") > fixed.LAPSED_DAYS,
               filled(fixed.TIP_LAPSED, col("daysSinceLastOrder").cast("string"))),
        F.when(col("lifetimeOrderCount") > fixed.LOYAL_ORDERS, F.lit(fixed.TIP_LOYAL)),
    )


def format_profile() -> Column:
    """Profile as labelled lines, money with two decimals."""
    preferences = F.concat_ws(
        ", ",
        part("Category: ", col("preferredCategoryL1")),
        part("Theme: ", col("preferredTheme")),
        part("Occasion: ", col("preferredOccasion")),
    )
    return F.concat_ws(
        "\n",
        always("Customer ID: ", col("userId")),
        part("Type: ", col("customerType")),
        part("Segment: ", col("customerSegment")),
        part("Preferences: ", preferences),
        part("Price Affinity: ", col("priceAffinity")),
        _location(),
        part("Lifetime Orders: ", col("lifetimeOrderCount")),
        part("Lifetime Spend: $", money(col("lifetimeSpend"))),
        part("Avg Order Value: $", money(col("avgOrderValue"))),
        part("Days Since Last Order: ", col("daysSinceLastOrder")),
    )


def format_event_line() -> Column:
    """`- date: action item qty q ($p) via s`, date as the UTC day."""
    in_range = F.abs(col("timestamp")) < 253402300800  # up to the year 9999; else no day is shown
    day = F.when(in_range, F.date_format(F.timestamp_seconds(F.when(in_range, col("timestamp"))), "yyyy-MM-dd"))
    return F.concat(
        F.lit("- "), F.coalesce(day, F.lit("?")), F.lit(": "),
        F.coalesce(blank_to_null(col("eventType")), F.lit("event")), F.lit(" "),
        F.coalesce(blank_to_null(col("itemId")), F.lit("?")),
        F.coalesce(part(" qty ", nonzero(col("quantity"))), F.lit("")),
        F.coalesce(F.concat(F.lit(" ($"), plain_number(col("price")), F.lit(")")), F.lit("")),
        F.coalesce(part(" via ", col("recommendationId")), F.lit("")),
    )


def fill_placeholders(template: str, values: dict[str, Column]) -> Column:
    """Replace `{{NAME}}` marks by columns; unknown marks stay visible."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return text
