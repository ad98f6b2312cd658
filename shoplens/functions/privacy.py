"""Anonymization, masking and text flags, all as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shoplens import fixed

# Shapes of personal data. Plain character classes, so the same
# text matches in any regular-expression engine.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(\+?1[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
SSN = r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)"
CVV = r"(?i)(cvv2?|cvc)[^0-9a-z]{0,5}[0-9]{3,4}"
EXPIRY = r"(?i)(exp|expiry|expires)[^0-9a-z]{0,10}(0[1-9]|1[0-2])[/-][0-9]{2,4}"
ROUTING = r"(?i)(routing|aba)[^0-9]{0,20}[0-9]{9}"
BANK_ACCOUNT = r"(?i)account[^0-9]{0,20}[0-9]{8,17}"


def hash_ids(c: Column, salt: str, digits: int = 16) -> Column:
    """`CUST-` + the first hex digits of the salted SHA-256."""
    digest = F.sha2(F.concat(c.cast("string"), F.lit(salt)), 256)
    return F.concat(F.lit("CUST-"), F.upper(F.substring(digest, 1, digits)))


def hex_bucket(c: Column, buckets: int) -> Column:
    """Stable bucket of a text, from the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def generalize_columns(df: DataFrame, id_col: str = "userId",
                       labels: list[str] = fixed.REGION_LABELS) -> DataFrame:
    """City to one of a few regions, unknown types to CONSUMER, unit blanked."""
    names = F.array(*[F.lit(x) for x in labels])
    place = (hex_bucket(F.col(id_col), len(labels)) + 1).cast("int")
    kept = F.col("customerType").isin(fixed.CUSTOMER_TYPES_KEPT)
    return df.withColumns({
        "region": F.when(F.col("region") != "", F.element_at(names, place))
                   .otherwise(F.col("region")),
        "customerType": F.when((F.col("customerType") == "") | kept, F.col("customerType"))
                         .when(F.col("customerType").isNotNull(), F.lit("CONSUMER")),
        "businessUnit": F.when(F.col("businessUnit").isNotNull(), F.lit("")),
    })


def scrub_text(df: DataFrame, rules: list[tuple[str, str]],
               columns: list[str] | None = None) -> DataFrame:
    """Apply (pattern, replacement) rules in turn to text columns, all by default."""
    names = columns or [f.name for f in df.schema.fields
                        if isinstance(f.dataType, T.StringType)]
    scrubbed = {}
    for name in names:
        text = F.col(name)
        for pattern, replacement in rules:
            text = F.regexp_replace(text, pattern, replacement)
        scrubbed[name] = text
    return df.withColumns(scrubbed)


def generalize_maker(df: DataFrame, maker: str = "Generic Maker",
                     brand: str = "Generic Brand") -> DataFrame:
    def label(name: str, value: str) -> Column:
        return F.when(F.col(name) != "", F.lit(value)).otherwise(F.col(name))
    return df.withColumns({"manufacturer": label("manufacturer", maker),
                           "brand": label("brand", brand)})


def placeholder_url(item_id: Column, kind: str = "products", suffix: str = "",
                    site: str = "https://example.com") -> Column:
    return F.concat(F.lit(f"{site}/{kind}/"), item_id.cast("string"), F.lit(suffix))


def luhn_valid(digits: Column) -> Column:
    """Luhn check of a digit text."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    weighted = F.transform(places, lambda d, i: F.when(
        i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(weighted, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def pii_mask(df: DataFrame, text: str = "text") -> DataFrame:
    """Mask e-mail and phone, flag rows with card, bank and identity numbers."""
    # Every pattern but the address needs a digit, and most texts have none: one
    # cheap test keeps the long patterns off them.
    rows = df.withColumn("_digit", F.coalesce(F.rlike(F.col(text), F.lit("[0-9]")), F.lit(False)))
    source, digit = F.col(text), F.col("_digit")
    cards = F.transform(F.regexp_extract_all(source, F.lit(f"({CARD})"), 1),
                        lambda c: F.regexp_replace(c, "[^0-9]", ""))
    no_mail = F.when(F.contains(source, F.lit("@")),
                     F.regexp_replace(source, EMAIL, "{EMAIL}")).otherwise(source)

    def found(pattern: str) -> Column:
        return digit & F.rlike(source, F.lit(pattern))

    return rows.withColumns({
        "masked": F.when(digit, F.regexp_replace(no_mail, PHONE, "{PHONE}")).otherwise(no_mail),
        "has_card": digit & F.exists(cards, luhn_valid),
        "has_cvv": found(CVV),
        "has_expiry": found(EXPIRY),
        "has_ssn": found(SSN),
        "has_bank": found(BANK_ACCOUNT),
        "has_routing": found(ROUTING),
    }).drop("_digit")


def normal_words(text: Column) -> Column:
    """Letters and digits of all scripts in lower case, accents apart from their letters joined, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


FEW = 32
_PHRASES = "array<struct<phrase:string,at:int,topic:string>>"


def phrase_table(spark: SparkSession, topics: dict[str, list[str]]) -> tuple[Column, int, list[int]]:
    """The phrases by hash, as a constant; its number of places; the lengths of phrases in words."""
    rows = [(topic, phrase, at) for at, (topic, phrases) in enumerate(topics.items()) for phrase in phrases]
    places = 1 << max(4, (2 * len(rows)).bit_length())
    given = spark.createDataFrame(rows, "topic string, phrase string, at int").withColumn("phrase", normal_words(F.col("phrase")))
    given = given.filter("phrase <> ''").withColumns({
        "place": F.pmod(F.xxhash64("phrase"), F.lit(places)).cast("int"), "words": F.size(F.split("phrase", " "))})
    table, lengths = [[] for _ in range(places)], set()
    for r in given.collect():       # the caller's own list
        table[r.place].append({"phrase": r.phrase, "at": r["at"], "topic": r.topic})
        lengths.add(r.words)
    return F.from_json(F.lit(json.dumps(table)), f"array<{_PHRASES}>"), places, sorted(lengths)


def _few_topics(df: DataFrame, topics: dict[str, list[str]], text: str) -> DataFrame:
    spaced = F.concat(F.lit(" "), normal_words(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))

    def named(words: Column) -> Column:
        found = []
        for topic, phrases in topics.items():
            hit = F.lit(False)
            for phrase in phrases:
                own = normal_words(F.lit(phrase))
                hit = hit | ((own != "") & F.contains(words, F.concat(F.lit(" "), own, F.lit(" "))))
            found.append(F.when(hit, F.lit(topic)))
        return F.concat_ws(",", *found)

    return df.withColumn("topics", F.get(F.transform(F.array(spaced), named), F.lit(0)))


def denied_topic_flags(df: DataFrame, topics: dict[str, list[str]] | None = None,
                       text: str = "text") -> DataFrame:
    """Add `topics`: names of the topics one of whose phrases occurs in the text, in the order of `topics`.

    Texts and phrases are brought to the same form; a phrase matches as whole
    words, whatever case, spacing and punctuation. The word groups of a text, of
    the lengths that phrases have, are looked up in a hash table of the phrases,
    so the cost of a text does not depend on their number. FEW phrases are
    looked for one by one, which is cheaper and finds the same.
    """
    topics = fixed.TOPIC_TERMS if topics is None else topics
    if sum(map(len, topics.values())) <= FEW:
        return _few_topics(df, topics, text)
    table, places, lengths = phrase_table(df.sparkSession, topics)
    words = F.split(normal_words(F.coalesce(F.col(text), F.lit(""))), " ")

    def found(words: Column, n: int) -> Column:
        """Phrases of n words in the text."""
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        groups = words if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        hits = F.transform(F.array_distinct(groups), lambda g: F.filter(
            F.get(table, F.pmod(F.xxhash64(g), F.lit(places)).cast("int")), lambda p: p["phrase"] == g))
        return F.coalesce(F.flatten(F.filter(hits, lambda h: F.size(h) > 0)),
                          F.array().cast(_PHRASES))

    def named(words: Column) -> Column:
        hits = F.concat(*[found(words, n) for n in lengths]) if lengths else F.array().cast(_PHRASES)
        once = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["at"], h["topic"]))))
        return F.array_join(F.transform(once, lambda h: h["topic"]), ",")

    return df.withColumn("topics", F.get(F.transform(F.array(words), named), F.lit(0)))
