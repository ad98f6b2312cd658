"""Conversation payload fields and chat-response classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoplens import fixed


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract_event_fields(payload_json: Column) -> tuple[Column, Column]:
    """Role and text of a payload; `content` may be a text or hold `text`."""
    payload = F.try_parse_json(payload_json)
    content = F.try_variant_get(payload, "$[0].conversational.content", "variant")
    role = F.try_variant_get(payload, "$[0].conversational.role", "string")
    text = F.coalesce(
        F.try_variant_get(payload, "$[0].conversational.content.text", "string"),
        F.when(F.schema_of_variant(content) == "STRING",
               F.try_variant_get(content, "$", "string")),
        F.lit(""),
    )
    return role, text


def classify_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `type`, `message`, `recommendations`, `followups`, `tools_called` and `blocked_reason`.

    A block marker decides first. Otherwise scratchpad tags are removed and the
    fenced, the whole and the braced text are tried as JSON in that order; the
    first with a known type and a text message wins. The rest is prose. Product
    cards belong to answers, questions to follow-ups; elsewhere the lists are empty.
    """
    source = F.coalesce(F.col(raw), F.lit(""))
    blocked = F.contains(source, F.lit(fixed.BLOCK_MARKER))
    mid_stream = _strip(F.substring_index(source, fixed.BLOCK_MARKER, 1)) != ""

    cleaned = source
    for tag in fixed.SCRATCHPAD_TAGS:
        cleaned = F.regexp_replace(cleaned, f"(?is)<{tag}>.*?</{tag}>", "")
    rows = df.withColumn("_cleaned", _strip(cleaned))

    cleaned = F.col("_cleaned")
    candidates = F.array(
        _strip(F.regexp_extract(cleaned, fixed.FENCED_JSON, 1)),
        cleaned,
        F.regexp_extract(cleaned, fixed.BRACED_JSON, 0),
    )

    def parsed(text: Column) -> Column:
        value = F.try_parse_json(F.when(F.startswith(text, F.lit("{")), text))
        message = F.try_variant_get(value, "$.message", "variant")
        return F.struct(
            F.try_variant_get(value, "$.type", "string").alias("type"),
            F.when(F.schema_of_variant(message) == "STRING",
                   F.try_variant_get(message, "$", "string")).alias("message"),
            value.alias("value"),
        )

    valid = F.filter(F.transform(candidates, parsed),
                     lambda p: p["type"].isin(fixed.RESPONSE_TYPES) & p["message"].isNotNull())
    rows = rows.withColumn("_hit", F.try_element_at(valid, F.lit(1)))

    def part(path: str, kind: str, only: str | None = None) -> Column:
        """A list of the structured half, without nulls."""
        found = F.try_variant_get(F.col("_hit.value"), path, f"array<{kind}>")
        wanted = ~blocked & (F.col("_hit.type") == only if only else F.lit(True))
        return F.coalesce(F.when(wanted, F.array_compact(found)), F.array().cast(f"array<{kind}>"))

    return rows.withColumns({
        "type": F.when(blocked, "blocked")
                 .otherwise(F.coalesce(F.col("_hit.type"), F.lit("answer"))),
        "message": F.when(blocked & mid_stream, fixed.BLOCK_MID_TEXT)
                    .when(blocked, fixed.BLOCK_FULL_TEXT)
                    .otherwise(F.coalesce(F.col("_hit.message"),
                                          F.nullif(cleaned, F.lit("")), source)),
        "recommendations": part("$.recommendations", fixed.PRODUCT_CARD, "answer"),
        "followups": part("$.followups", fixed.FOLLOWUP, "followup"),
        "tools_called": part("$.meta.toolsCalled", "string"),
        "blocked_reason": F.when(blocked & mid_stream, "mid-stream")
                           .when(blocked, "full-block"),
    }).drop("_cleaned", "_hit")
