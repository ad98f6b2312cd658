from decimal import Decimal

from pyspark.sql import functions as F

from shoplens import fixed
from shoplens.functions import clean
from shoplens.sources import files

MESSY = '''﻿ITEM_ID,TITLE,PRICE,AVAILABILITY,SPECIAL_OCCASION_OR_EVENT,BULK_ASSORTMENTS
0042, "Balloon, red ""big""" ,"$1,234.50",In Stock,Birthday,Bulk

 7 ,b
8,c,1.2.3,out of stock,,,extra
9,,-5,yes,Wedding,
,no id,3,yes,,
10,d,abc,,,
'''


def test_messy_csv(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text(MESSY, encoding="utf-8")
    raw = files.read_messy_csv(spark, str(path))
    assert sum(r[files.BAD] is not None for r in raw.collect()) == 2
    got = {r.id: r for r in clean.clean_products(raw).collect()}
    assert set(got) == {"0042", "7", "8", "9", "10"}
    first = got["0042"]
    assert first.name == 'Balloon, red "big"'
    assert first.price == Decimal("1234.50") and first.inStock and first.isBulk
    assert first.occasion == "Birthday" and first.description == first.name
    assert got["7"].price == 0 and got["7"].inStock is True and got["7"].isBulk is None
    assert got["8"].price == Decimal("1.20") and got["8"].inStock is False
    assert got["9"].name == "9" and got["9"].price == Decimal("5.00")
    assert got["10"].price == 0


def test_numbers(spark):
    words = ["", None, "12", " -3.5 kg", "1e3x", ".5", "x1", "5."]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r.n for r in df.select(clean.parse_number(F.col("v")).alias("n")).collect()]
    assert got == [None, None, 12.0, -3.5, 1000.0, 0.5, None, 5.0]
    prices = [r.p for r in df.select(clean.parse_price(F.col("v")).alias("p")).collect()]
    assert prices == [Decimal(x) for x in ("0", "0", "12", "3.5", "13", "0.5", "1", "5")]


def test_truthiness(spark):
    df = spark.createDataFrame(
        [(None, "B", 0, 5), ("", "B", 3, 5), ("0", "B", None, 0), (" ", None, 0, 0)],
        "userId string, USER_ID string, quantity int, QUANTITY int")
    got = clean.coalesce_aliases(df, fixed.INTERACTION_ALIASES).select("userId", "quantity")
    assert [tuple(r) for r in got.collect()] == [
        ("B", "5"), ("B", "3"), ("0", None), (None, None)]


def test_enums(spark, rows):
    df = spark.createDataFrame([("view", "LOW"), ("click", "LOW"), (None, "X")],
                               "eventType string, priceAffinity string")
    got = clean.validate_enums(df, {"eventType": fixed.EVENT_TYPES,
                                    "priceAffinity": fixed.PRICE_AFFINITIES})
    assert [r.rejected for r in got.collect()] == [None, "eventType", "eventType,priceAffinity"]


def test_jsonl_quarantine(spark, tmp_path):
    from shoplens import schemas
    from shoplens.operators.joins import rejected_embeddings, valid_embeddings
    lines = [b'{"recordId":"a","modelOutput":{"embedding":[1.0,2.0]}}',
             b'{"recordId":"b","error":{"errorCode":"400","errorMessage":"x"}}',
             b'{"recordId":"c"}', b'{"modelOutput":{"embedding":[1.0]}}',
             b'{"recordId":"d","modelOut', b'', b'   ',
             b'{"recordId":"\xff","modelOutput":{"embedding":[3.0]}}']
    (tmp_path / "r.jsonl").write_bytes(b"\n".join(lines))
    good, bad = files.split_bad(
        files.read_jsonl_lenient(spark, str(tmp_path), schemas.EMBED_RESULT))
    assert bad.count() == 1
    assert sorted(r.key for r in valid_embeddings(good).collect()) == ["a", "�"]
    assert {r.recordId: r.reason for r in rejected_embeddings(good).collect()} == {
        "b": "error", "c": "no vector", None: "no id"}


def test_discover(spark, tmp_path):
    for name in ("part-00000-a.txt", "part-1-b.txt", ".part-00001-c.txt.crc", "x.jsonl",
                 "y.jsonl.out"):
        (tmp_path / name).write_text("x")
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "part-00002-d.txt").write_text("x")
    names = [r.path.split("/")[-1] for r in files.discover_chunks(spark, str(tmp_path)).collect()]
    assert names == ["part-00000-a.txt"]
    outs = [r.path.split("/")[-1] for r in files.discover_outputs(spark, str(tmp_path)).collect()]
    assert outs == ["y.jsonl.out"]
