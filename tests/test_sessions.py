import random

from pyspark.sql import Window, functions as F

from shoplens.operators import sessions as se

MESSAGE = ("actorId string, sessionId string, role string, content string, timestamp long, "
           "turn long")


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def test_rollup(spark):
    df = messages(spark, [
        ("a", "s1", "ASSISTANT", "hello", 1, 0), ("a", "s1", "USER", "x" * 300, 5, 1),
        ("a", "s1", "USER", "later", 9, 2), ("a", "s2", "ASSISTANT", "only me", 3, 0),
        ("a", "s3", "USER", None, 2, 0), ("a", "s3", "USER", "second", 4, 1),
        ("anonymous", "s4", "USER", "hi", 9, 0)])
    got = {r.sessionId: r for r in se.session_rollup(df).collect()}
    assert got["s1"].firstPrompt == "x" * 200
    assert (got["s1"].createdAt, got["s1"].lastEventAt, got["s1"].n_events) == (1, 9, 3)
    assert got["s2"].firstPrompt == "" and got["s3"].firstPrompt == ""
    listed = se.list_sessions(df, 3, 2).orderBy("place").collect()
    assert [(r.sessionId, r.place) for r in listed] == [("s1", 1), ("s3", 2)]
    assert {r.sessionId: r.firstPrompt for r in se.first_prompt(df).collect()} == {
        k: v.firstPrompt for k, v in got.items()}


def test_timeline_of_a_hot_session(spark):
    random.seed(2)
    data = [("a", "hot" if random.random() < 0.6 else f"s{i % 9}", random.choice(["USER", "", None]),
             random.choice(["t", "t", ""]), random.randint(0, 40_000_000), i)
            for i in range(3000)]
    df = messages(spark, data)
    over = Window.partitionBy("actorId", "sessionId").orderBy("timestamp", "turn")
    want = se.valid_messages(df).select(
        "turn", F.row_number().over(over).alias("position"),
        (F.col("timestamp") - F.lag("timestamp").over(over)).alias("delay_ms"))
    got = se.session_timeline(df).select("turn", "position", "delay_ms")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_history_limits(spark):
    df = messages(spark, [("a", "s", "User", f"m{i}", i, i) for i in range(150)])
    assert se.session_history(df).count() == 50
    assert se.session_history(df, 1000).count() == 150
    assert se.session_history(df, 0).count() == 0
    last = se.recent_events_text(df, 3).orderBy("recency").collect()
    assert [r.content for r in last] == ["m149", "m148", "m147"]


def test_responses(spark):
    from shoplens import fixed
    from shoplens.functions.envelope import classify_responses, extract_event_fields
    cases = [
        ('{"type":"answer","message":"hi"}', "answer", "hi"),
        ('```json\n{"type":"followup","message":"which?"}\n```', "followup", "which?"),
        ('Sure: {"type":"answer","message":"a } b"} bye', "answer", "a } b"),
        ('<Thinking>x\ny</thinking>{"type":"answer","message":"z"}', "answer", "z"),
        (fixed.BLOCK_MARKER, "blocked", fixed.BLOCK_FULL_TEXT),
        ("so " + fixed.BLOCK_MARKER, "blocked", fixed.BLOCK_MID_TEXT),
        ("plain prose", "answer", "plain prose"),
        ("<thinking>all</thinking>", "answer", "<thinking>all</thinking>"),
        ('{"type":"other","message":"m"}', "answer", '{"type":"other","message":"m"}'),
        ('{"type":"answer","message":5}', "answer", '{"type":"answer","message":5}'),
        ('{"type":"answer","mess', "answer", '{"type":"answer","mess'),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = {r.i: (r.type, r.message) for r in classify_responses(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    whole = ('{"type":"%s","message":"m","recommendations":[{"id":"1","price":9.5,"score":0.25,"other":1},null],'
             '"followups":[{"id":"q","label":"L","options":[{"label":"A","value":"a"}]}],"meta":{"toolsCalled":["x"]}}')
    odd = '{"type":"answer","message":"m","recommendations":"none","meta":5}'
    rich = spark.createDataFrame([(1, whole % "answer"), (2, whole % "followup"), (3, odd), (4, fixed.BLOCK_MARKER), (5, None)],
                                 "i int, raw string")
    got = {r.i: r for r in classify_responses(rich).collect()}
    card, = got[1].recommendations
    assert (card.id, card.price, card.score, card.title, got[1].followups) == ("1", "9.5", 0.25, None, [])
    question, = got[2].followups
    assert (question.label, question.options[0].value, got[2].recommendations) == ("L", "a", [])
    assert got[1].tools_called == got[2].tools_called == ["x"]
    assert all(got[i].recommendations == got[i].followups == got[i].tools_called == [] for i in (3, 4, 5))
    payloads = ['[{"conversational":{"role":"USER","content":{"text":"a"}}}]',
                '[{"conversational":{"role":"USER","content":"b"}}]', "[]", "oops"]
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    role, text = extract_event_fields(F.col("p"))
    assert [tuple(r) for r in df.select(role, text).collect()] == [
        ("USER", "a"), ("USER", "b"), (None, ""), (None, "")]
