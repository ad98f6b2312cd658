"""Operational metrics from log lines, and threshold alerts.

Log rows are `(ts timestamp, line string)`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoplens import fixed
from shoplens.session import materialize

# Markers of the log lines.
TOOL = r"\[envelope\] tool=([a-z_]+)"
LATENCY = r"request completed.*responseTime=([0-9]+)"
STATUS = r"status=([0-9]{3})"
CACHE = r"\[embed-cache\] hits=([0-9]+) misses=([0-9]+)"
BLOCKED = "[guardrail] Output blocked"
FACETS_LIVE = "[catalog-facets] Loaded from"
FACETS_FALLBACK = "using fallback"
PROMPTS_LIVE = r"\[prompts\] Loaded [0-9]+ sections"
PROMPTS_FALLBACK = "[prompt-loader] DDB read failed"


def parse_log_lines(lines: DataFrame, process: str | None = None) -> DataFrame:
    """Fields of each line; absent ones are null."""
    def number(marker: str, pattern: str, group: int = 1) -> Column:
        # The marker test spares lines of other kinds the regular expression.
        digits = F.regexp_extract("line", pattern, group)
        return F.when(has(marker), digits.try_cast("bigint"))

    def has(text: str) -> Column:
        return F.contains(F.col("line"), F.lit(text))

    return lines.select(
        "ts", (F.col(process).cast("string") if process else F.lit("")).alias("process"),
        F.when(has("tool="), F.nullif(F.regexp_extract("line", TOOL, 1), F.lit(""))).alias("tool"),
        number("responseTime=", LATENCY).alias("latency_ms"),
        number("status=", STATUS).alias("status"),
        number("hits=", CACHE, 1).alias("cache_hits"),
        number("hits=", CACHE, 2).alias("cache_misses"),
        has(BLOCKED).alias("is_blocked"),
        has(FACETS_LIVE).alias("facets_live"),
        has(FACETS_FALLBACK).alias("facets_fallback"),
        F.rlike("line", F.lit(PROMPTS_LIVE)).alias("prompts_live"),
        has(PROMPTS_FALLBACK).alias("prompts_fallback"))


COUNTS = ["requests", "tool_calls", "blocked", "facet_loads", "facet_fallbacks", "prompt_loads",
          "prompt_fallbacks", "errors", "hits", "misses"]
QUANTILES = (50, 95, 99)        # in hundredths


def _windowed(lines: DataFrame, minutes: int) -> DataFrame:
    process = "process" if "process" in lines.columns else None
    return parse_log_lines(lines, process).withColumn(
        "window_start", F.window("ts", f"{minutes} minutes")["start"])


def _counts() -> list[Column]:
    """Counts of the lines, and the smallest and largest running totals of the cache."""
    totals = F.struct("cache_hits", "cache_misses")
    caching = F.col("cache_hits").isNotNull() & F.col("cache_misses").isNotNull()
    return [
        F.count("latency_ms").alias("requests"),
        F.count("tool").alias("tool_calls"),
        *[F.count_if(F.col(name)).alias(metric) for name, metric in (
            ("is_blocked", "blocked"), ("facets_live", "facet_loads"), ("facets_fallback", "facet_fallbacks"),
            ("prompts_live", "prompt_loads"), ("prompts_fallback", "prompt_fallbacks"))],
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.min(F.when(caching, totals)).alias("low"), F.max(F.when(caching, totals)).alias("high")]


def _with_rises(per_process: DataFrame) -> DataFrame:
    """The rows of a window and process with `hits` and `misses` in place of `low` and `high`.

    Cache lines carry running totals of a process (column `process`, if there is
    one), so a window's share is the rise of its largest totals over the window
    before; a total that falls is a restart. The first window of a process counts
    from its own smallest totals.
    """
    by = Window.partitionBy("process").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("high", ignorenulls=True).over(by)

    def rise(total: str) -> Column:
        before = F.coalesce(F.col("last")[total], F.col("low")[total])
        now = F.col("high")[total]
        return F.coalesce(F.when(now >= before, now - before).otherwise(now), F.lit(0))

    return per_process.withColumn("last", last).select(
        "*", rise("cache_hits").alias("hits"), rise("cache_misses").alias("misses")).drop("low", "high", "last")


def _metrics(sums: DataFrame, minutes: int, quantile) -> DataFrame:
    """Metrics of the summed counts of windows `w`; `quantile(q)` is that of the latencies, q in hundredths."""
    def rate(part: Column, whole: Column) -> Column:
        return F.round(F.when(whole > 0, part / whole), 6)

    requests = F.col("requests")
    return sums.select(
        F.col("w.start").alias("window_start"), F.lit(minutes).alias("minutes"), *COUNTS[:-2],
        *[quantile(q).alias(f"latency_p{q}_ms") for q in QUANTILES],
        rate(F.col("errors"), requests).alias("error_rate"),
        rate(F.col("blocked"), requests).alias("block_rate"),
        rate(F.col("prompt_fallbacks"), F.col("prompt_loads") + F.col("prompt_fallbacks")).alias("prompt_fallback_rate"),
        rate(F.col("hits"), F.col("hits") + F.col("misses")).alias("cache_hit_rate"))


def _window(minutes: int) -> Column:
    return F.window("window_start", f"{minutes} minutes").alias("w")


def log_sketches(lines: DataFrame, minutes: int, k: int = 4096) -> DataFrame:
    """Mergeable metrics per small window: counts, latency sketches, counter increments.

    One pass of the log, for logs kept for long: latencies go into KLL sketches of
    bounded size, exact up to about `k` values and within about 1/k in rank beyond.
    `latency_counts` keeps every latency.
    """
    sketch = F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("latency")
    return _with_rises(_windowed(lines, minutes).groupBy("window_start", "process").agg(*_counts(), sketch))


def roll_up(sketches: DataFrame, minutes: int) -> DataFrame:
    """Metrics per window of any length that the small windows add up to."""
    rows = sketches.groupBy(_window(minutes)).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.kll_merge_agg_double("latency").alias("latency"))
    return _metrics(rows, minutes, lambda q: F.when(F.col("requests") > 0, F.kll_sketch_get_quantile_double(
        "latency", F.lit(q / 100))).cast("long"))


def latency_counts(lines: DataFrame, minutes: int) -> DataFrame:
    """Counts per small window, process and latency: as mergeable as the sketches, and exact.

    One pass of the log; lines of one latency combine before they are moved.
    """
    return _windowed(lines, minutes).groupBy("window_start", "process", "latency_ms").agg(*_counts())


def roll_up_counts(counts: DataFrame, minutes: int) -> DataFrame:
    """Metrics with exact percentiles per window of any length that the small windows add up to.

    A percentile is the smallest latency that so many hundredths of the requests do not exceed.
    """
    per_process = counts.groupBy("window_start", "process").agg(
        *[F.sum(c).alias(c) for c in COUNTS[:-2]], F.min("low").alias("low"), F.max("high").alias("high"))
    sums = _with_rises(per_process).groupBy(_window(minutes)).agg(*[F.sum(c).alias(c) for c in COUNTS])
    held = counts.filter("latency_ms is not null").groupBy(_window(minutes), "latency_ms").agg(
        F.sum("requests").alias("n"))
    by = Window.partitionBy("w")
    held = held.withColumn("below", F.sum("n").over(by.orderBy("latency_ms"))).withColumn("all", F.sum("n").over(by))
    found = held.groupBy("w").agg(*[
        F.min(F.when(F.col("below") * 100 >= F.col("all") * q, F.col("latency_ms"))).alias(f"p{q}") for q in QUANTILES])
    return _metrics(sums.join(found, "w", "left"), minutes, lambda q: F.col(f"p{q}"))


def log_metrics(lines: DataFrame, minutes: int) -> DataFrame:
    """Counts, rates and latency percentiles per time window."""
    return roll_up_counts(materialize(latency_counts(lines, minutes), "log-counts"), minutes)


def tool_counts(lines: DataFrame) -> DataFrame:
    return (parse_log_lines(lines).filter(F.col("tool").isNotNull())
            .groupBy("tool").agg(F.count("*").alias("calls")))


def alert_rules(lines: DataFrame, rules: list[tuple] = fixed.ALERT_RULES) -> DataFrame:
    """Windows whose metric breaks its threshold, from one pass of the log for all window lengths."""
    lengths = sorted({rule[3] for rule in rules})
    counts = materialize(latency_counts(lines, math.gcd(*lengths)), "log-counts")
    fired = []
    for minutes in lengths:
        metrics = roll_up_counts(counts, minutes)
        breaks = []
        for metric, sign, threshold, _, severity in (r for r in rules if r[3] == minutes):
            value = F.col(metric).cast("double")
            bad = value > threshold if sign == ">" else value < threshold
            breaks.append(F.when(bad, F.struct(
                F.lit(metric).alias("metric"), value.alias("value"),
                F.lit(float(threshold)).alias("threshold"), F.lit(severity).alias("severity"))))
        fired.append(metrics.select("window_start", "minutes",
                                    F.inline(F.array_compact(F.array(*breaks)))))
    return reduce(DataFrame.unionByName, fired)
