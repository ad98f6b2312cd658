from pyspark.sql import functions as F

from shoplens.functions import privacy
from shoplens.operators import behavior as bh, customers as cu, ledger as lg, logs as lo, orders as od


def test_ledger(spark):
    chunks = spark.createDataFrame(
        [(r, f"p{i}") for r, n in (("done", 2), ("part", 3), ("bad", 1)) for i in range(n)],
        "run string, inputKey string")
    jobs = spark.createDataFrame(
        [("done", "t", 1, "p0", "Completed"), ("done", "t", 1, "p1", "Completed"),
         ("part", "t", 2, "p0", "Completed"), ("part", "t", 2, "p1", "InProgress"),
         ("bad", "u", 1, "p0", "Stopped")],
        "run string, dataType string, startedAt int, inputKey string, status string")
    assert [tuple(r) for r in lg.remaining_chunks(chunks, jobs).collect()] == [("part", "p2")]
    ledger = lg.run_ledger(chunks, jobs)
    got = {r.run: r for r in ledger.collect()}
    assert got["done"].complete and got["done"].all_complete and not got["done"].any_failed
    assert not got["part"].complete and not got["part"].all_complete and got["part"].open == 1
    assert got["bad"].all_complete and got["bad"].any_failed
    assert {r.dataType: r.run for r in lg.latest_run_per_type(jobs).collect()} == {
        "t": "part", "u": "bad"}
    assert lg.publishable_runs(ledger, jobs).count() == 0


def test_masking(spark):
    texts = ["mail a.b@x.org or (555) 123-4567", "card 4111 1111 1111 1111.",
             "card 4111 1111 1111 1112.", "ssn 123-45-6789", "cvv: 123, exp 04/27",
             "routing no. 021000021, account 123456789", "plain 12345"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = {r.i: r for r in privacy.pii_mask(df).collect()}
    assert got[0].masked == "mail {EMAIL} or {PHONE}"
    assert got[1].has_card and not got[2].has_card and got[3].has_ssn
    assert got[4].has_cvv and got[4].has_expiry
    assert got[5].has_routing and got[5].has_bank
    assert not any([got[6].has_card, got[6].has_ssn, got[6].has_bank])


def test_scrub_and_topics(spark):
    rules = [(r"(?i)acme party", "PSC"), (r"(?i)acmeparty\.com", "example.com"), (r"\bAPX\b", "PSC")]
    df = spark.createDataFrame([(1, "ACME Party at acmeparty.com, APX not APXY", "Acme party")],
                               "n int, a string, b string")
    assert tuple(privacy.scrub_text(df, rules).first()) == (
        1, "PSC at example.com, PSC not APXY", "PSC")
    text = spark.createDataFrame([("Should I VOTE,  or sue?",), ("devoted tissue",)], "text string")
    assert [r.topics for r in privacy.denied_topic_flags(text).collect()] == [
        "Politics,LegalAdvice", ""]


def test_phrases_in_any_writing(spark):
    """Hyphens, accents, other scripts; whole words only; order of the topics; ten thousand phrases."""
    topics = {"B": ["Party-Shop", "crème brûlée", "\u65e5\u672c"], "A": ["ÉCOLE", "of  the"], "Empty": ["--", ""]}
    texts = ["My party shop!", "PARTY  SHOP of\tthe", "partyshop", "Crème-Brûlée?", "creme brulee", "\u65e5\u672c",
             "\u65e5\u672c\u4eba", "une école", "", None, "of", "the of the"]
    df = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(texts)], "i int, text string, words string")
    got = {r.i: r.topics for r in privacy.denied_topic_flags(df, topics).collect()}
    assert [got[i] for i in range(len(texts))] == ["B", "B,A", "", "B", "", "B", "", "A", "", "", "", "A"]
    assert {r.topics for r in privacy.denied_topic_flags(df, {}).collect()} == {""}
    many = {"Many": [f"w{i} x{i} y{i}" for i in range(5000)] + [f"z{i}" for i in range(5000)], "Last": ["w7 x7"]}
    text = spark.createDataFrame([("so w4999 x4999 y4999 it is",), ("w7 x7 y8",), ("z4999",), ("z5000",)], "text string")
    assert [r.topics for r in privacy.denied_topic_flags(text, many).collect()] == ["Many", "Last", "Many", ""]


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "minute double, process string, line string").selectExpr(
        "timestamp_seconds(minute * 60) ts", "process", "line")


def test_cache_rate_is_that_of_the_window(spark):
    """Totals are differenced per process; a restart counts from zero."""
    cache = lambda m, p, h, n: (float(m), p, f"[embed-cache] hits={h} misses={n}")
    lines = lines_of(spark, [cache(0, "a", 100, 100), cache(1, "a", 110, 130), cache(6, "a", 200, 140), cache(7, "b", 5, 5),
                             cache(8, "b", 6, 8), cache(12, "a", 3, 1), cache(13, "b", 6, 8), cache(14, None, 1, 1)])
    got = {r.window_start.minute: r.cache_hit_rate for r in lo.log_metrics(lines, 5).collect()}
    assert got == {0: 0.25, 5: round(91 / (91 + 13), 6), 10: 0.75}
    wide, = lo.roll_up(lo.log_sketches(lines, 5), 60).collect()
    assert wide.cache_hit_rate == round((10 + 91 + 3) / (10 + 91 + 3 + 30 + 13 + 1), 6)


def test_markers_and_prompt_alarm(spark):
    rows = [(0.0, "a", "[catalog-facets] empty, using fallback"), (1.0, "a", "[catalog-facets] Loaded from 9 vectors"),
            (2.0, "a", "[prompt-loader] DDB read failed (Timeout)"), (6.0, "a", "[prompt-loader] DDB read failed (X)"),
            (7.0, "a", "[prompts] Loaded 3 sections")]
    first, second = lo.log_metrics(lines_of(spark, rows), 5).orderBy("window_start").collect()
    assert (first.facet_loads, first.facet_fallbacks, first.prompt_loads, first.prompt_fallbacks) == (1, 1, 0, 1)
    assert (first.prompt_fallback_rate, second.prompt_fallback_rate, first.latency_p99_ms) == (1.0, 0.5, None)
    fired = lo.alert_rules(lines_of(spark, rows)).collect()
    assert [(r.window_start.minute, r.metric) for r in fired] == [(0, "prompt_fallback_rate")]


def test_latency_sketches_add_up(spark):
    """Five-minute sketches give an hour's quantiles within their rank error; one scan serves all rules."""
    values = [(i * 7919) % 50021 for i in range(50000)]
    lines = spark.createDataFrame([(i * 0.07, "a", f"request completed status=200 responseTime={v}") for i, v in enumerate(values)],
                                  "s double, process string, line string").selectExpr("timestamp_seconds(s) ts", "process", "line")
    row, = lo.roll_up(lo.log_sketches(lines, 5, k=200), 60).collect()
    ordered = sorted(values)
    for q, got in ((0.5, row.latency_p50_ms), (0.95, row.latency_p95_ms), (0.99, row.latency_p99_ms)):
        assert abs(ordered.index(got) / len(ordered) - q) < 0.02
    exact, = lo.log_metrics(lines.limit(3000), 60).collect()
    some = sorted(values[:3000])
    assert (exact.latency_p50_ms, exact.latency_p95_ms) == (some[1499], some[2849])
    plan = lo.alert_rules(lines)._jdf.queryExecution().executedPlan().toString()
    assert "responseTime" not in plan       # the log itself was read before, once


def test_percentiles_of_many_requests_are_exact(spark):
    """More latencies than a sketch holds, in every process and window."""
    values = [(i * 7919) % 50021 for i in range(50000)]
    lines = spark.createDataFrame([(i * 0.07, "ab"[i % 2], f"request completed status=200 responseTime={v}")
                                   for i, v in enumerate(values)], "s double, process string, line string")
    lines = lines.selectExpr("timestamp_seconds(s) ts", "process", "line")
    ordered = sorted(values)
    for row in (lo.log_metrics(lines, 60).first(), lo.roll_up_counts(lo.latency_counts(lines, 5), 60).first()):
        assert row.requests == 50000
        assert (row.latency_p50_ms, row.latency_p95_ms, row.latency_p99_ms) == (
            ordered[24999], ordered[47499], ordered[49499])


def test_reach_from_daily_sketches(spark):
    """Any period from stored days, within three standard errors of the exact count."""
    events = spark.range(60000).selectExpr(
        "concat('i', id % 3) itemId", "concat('u', (id * 7919) % (20000 * (1 + id % 3))) userId", "(id % 10) * 86400 + 5 timestamp")
    stored = bh.reach_sketches(events)
    assert stored.count() == 30
    for first, last in ((None, None), (3, 5), (9, None)):
        some = events.filter(F.col("timestamp").between((first or 0) * 86400, (last if last is not None else 10) * 86400 + 86399))
        exact = {r.itemId: r.customers for r in bh.distinct_customers_per_item(some).collect()}
        got = {r.itemId: r.customers for r in bh.reach(stored, first, last).collect()}
        assert set(got) == set(exact) and all(abs(got[i] - n) <= max(1, 0.025 * n) for i, n in exact.items())


def test_anonymize(spark):
    df = spark.createDataFrame([("u1", "Austin", "PARTNER", "X"), ("u1", "Dallas", "BUSINESS", None),
                                ("u2", "", "", "")],
                               "userId string, region string, customerType string, "
                               "businessUnit string")
    got = privacy.generalize_columns(df).collect()
    assert got[0].region == got[1].region and got[2].region == ""
    assert [r.customerType for r in got] == ["CONSUMER", "BUSINESS", ""]
    assert [r.businessUnit for r in got] == ["", None, ""]
    hashed = [r.h for r in df.select(privacy.hash_ids(F.col("userId"), "s").alias("h")).collect()]
    assert hashed[0] == hashed[1] != hashed[2] and len(hashed[0]) == 21
    maker = spark.createDataFrame([("M", "B"), ("", None)], "manufacturer string, brand string")
    assert [tuple(r) for r in privacy.generalize_maker(maker).collect()] == [
        ("Generic Maker", "Generic Brand"), ("", None)]


def test_large_order_is_one_record(spark):
    items = spark.range(1, 2501).selectExpr(
        "'o' orderId", "cast(id as int) itemNo", "'p' productId", "'n' productName",
        "1L quantity", "cast(2 as decimal(12,2)) price")
    order, = od.item_lists(items).collect()
    assert [i.itemNo for i in order["items"]] == list(range(1, 2501))
    orders = spark.createDataFrame([("o", 5000), ("x", 1)], "id string, total int").withColumn(
        "total", F.col("total").cast("decimal(12,2)"))
    assert [r.orderId for r in od.order_totals_check(orders, items).collect()] == ["x"]


def test_customers(spark):
    df = spark.createDataFrame(
        [(f"c{i}", "PREMIUM" if i % 2 else "B2B", "North", None if i % 3 else "Sky")
         for i in range(120)],
        "userId string, customerSegment string, region string, preferredTheme string")
    assert cu.customer_typeahead(df, "").count() == 50
    assert cu.customer_typeahead(df, "SKY", 1000).count() == 40
    assert [r.userId for r in cu.customer_typeahead(df, "c11", 3).collect()] == [
        "c11", "c110", "c111"]
    page = df.withColumns({c: F.lit(None).cast("string") for c in (
        "customerType", "state", "priceAffinity")}).withColumn(
        "lifetimeSpend", F.lit(None).cast("decimal(12,2)"))
    first = cu.list_customers_page(page, 70).collect()
    rest = cu.list_customers_page(page, 70, first[-1].userId).collect()
    assert len(first) == 70 and len(rest) == 50
    assert not {r.userId for r in first} & {r.userId for r in rest}
