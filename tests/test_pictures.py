import time

import pytest
from pyspark.sql import functions as F

from hushframe.functions.spans import scan
from hushframe.operators import entities, layout, pictures, tools, tracking

SPANNED = "text string, spans array<struct<tag:string,start:int,end:int>>"


def spans_of(spark, fn, rows):
    found = spark.createDataFrame(rows, SPANNED).select(fn(F.col("text"), F.col("spans")).alias("s")).collect()
    return [r["s"] and [tuple(s) for s in r["s"]] for r in found]


def test_mended_emails(spark):
    text = "ask\n|ane.x@site.org and @b.org, c.org"
    rows = [(text, [("URL", 11, 19), ("URL", 25, 30), ("URL", 32, 37)]), ("@a.org", [("URL", 1, 6), ("NAME", 0, 1)]), (None, [("URL", 1, 2)]), ("x", None), ("", [])]
    got = spans_of(spark, pictures.mended_emails, rows)
    assert got[0] == [("EMAIL", 4, 19), ("EMAIL", 24, 30), ("URL", 32, 37)]
    assert got[1] == [("EMAIL", 0, 6), ("NAME", 0, 1)]
    assert got[3] is None and got[4] == []


def test_mended_emails_of_a_long_word(spark):
    text = "a" * 1_000_000 + "@b.org"
    assert spans_of(spark, pictures.mended_emails, [(text, [("URL", 1_000_001, 1_000_006)])]) == [[("EMAIL", 0, 1_000_006)]]


def test_readable_names(spark):
    values = {"Z": 0, "4 v": 0, "Jo": 1, "J 4": 0, "J. R": 1, "王": 1, "김": 1, "9Jo": 0, "É": 0, "Éa": 1}
    for value, kept in values.items():
        spans = [("NAME", 0, len(value)), ("CARD", 0, len(value))]
        got = spans_of(spark, pictures.readable_names, [(value, spans)])
        assert got == [spans[1 - kept :]], value


def test_one_line(spark):
    got = spark.createDataFrame([("a\nb\n",), (None,)], "t string").select(pictures.one_line(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == ["a b ", None]


def test_own_boxes(spark):
    boxes = spark.createDataFrame([(1, 0, 4, 0, 1.0, 1.0, 2.0, 2.0), (1, 0, 4, 1, 5.0, 1.0, 2.0, 2.0), (1, 6, 8, 0, 9.0, 1.0, 2.0, 2.0)], "p int, start int, end int, i int, x double, y double, w double, h double")
    rules = spark.createDataFrame([(1, 0, 4, 2, 7.0, 7.0, 7.0, 7.0), (1, 0, 4, 1, 3.0, 3.0, 3.0, 3.0), (1, 6, 8, 0, None, 1.0, 1.0, 1.0), (2, 6, 8, 0, 1.0, 1.0, 1.0, 1.0)], "p int, start int, end int, n int, x double, y double, w double, h double")
    got = {tuple(r) for r in pictures.with_own_boxes(boxes, rules, ["p"]).collect()}
    assert got == {(1, 0, 4, 0, 3.0, 3.0, 3.0, 3.0), (1, 6, 8, 0, 9.0, 1.0, 2.0, 2.0)}
    assert pictures.with_own_boxes(boxes.limit(0), rules, ["p"]).count() == 0


def test_text_height(spark):
    rows = [(1, 8.0), (1, 2.0), (1, 9.0), (1, 9.0), (2, 5.0), (2, 3.0), (3, 0.0), (4, None)]
    got = pictures.text_height(spark.createDataFrame(rows, "p int, h double"), ["p"]).collect()
    assert {r["p"]: r["height"] for r in got} == {1: 9.0, 2: 5.0, 3: 30.0}


def test_bars(spark):
    rects = spark.createDataFrame([(1, 0, 4, 9.0, 5.0), (1, 0, 4, 1.0, 5.0), (1, 0, 4, 0.0, 3.0), (2, 7, 9, 0.0, 0.0)], "p int, start int, end int, x0 double, y0 double").selectExpr("*", "x0 + 1 AS x1", "y0 + 1 AS y1")
    bars = layout.keyed_bars(rects, ["p"])
    assert {(r["key"], r["x0"]) for r in bars.collect()} == {("1:0:4:0", 0.0), ("1:0:4:1", 1.0), ("1:0:4:2", 9.0), ("2:7:9:0", 0.0)}
    off = spark.createDataFrame([("1:0:4:1",), ("1:0:4:1",), (None,), ("none",)], "key string")
    manual = spark.createDataFrame([(1, True), (3, None)], "p int, on boolean")
    found = layout.switched(bars, off, manual)
    pages = spark.createDataFrame([(1, "a"), (1, None), (2, " \n"), (4, None)], "p int, text string")
    assert {tuple(r) for r in layout.status(pages, found, "p").collect()} == {(1, 2, 4, 3, False), (2, 1, 1, 1, True), (4, 1, 0, 0, True)}


def test_shown_follows_parents(spark):
    covers = spark.createDataFrame([(1, k, 0.0, 5.0) for k in range(1, 5)] + [(2, 1, 0.0, 5.0)], "v int, track int, t double, x double")
    parents = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], "v int, track int, parent_track int")
    off = spark.createDataFrame([(1, 1), (1, 1), (1, 4)], "v int, track int")
    got = {(r["v"], r["track"]) for r in tracking.shown(covers, parents, off, ["v"], ["track"]).collect()}
    assert got == {(1, 2), (1, 4), (2, 1)}  # 3 goes with 1; 4 stays, as its own switch does not count


def test_once_per_text(spark):
    rows = [(1, "a", "en"), (2, "a", "en"), (3, "a", "th"), (4, None, "en"), (5, "", "en"), (6, "a", None)]
    asked = []

    def infer(df):
        asked.append(df.count())
        return df.withColumn("found", F.concat("model", F.lit(":"), "text"))

    got = entities.once_per_text(spark.createDataFrame(rows, "id int, text string, model string"), infer)
    assert {(r["id"], r["found"]) for r in got.collect()} == {(1, "en:a"), (2, "en:a"), (3, "th:a"), (4, None), (5, "en:"), (6, None)}
    assert asked == [3] and got.columns == ["id", "text", "model", "found"]


def test_tools(spark):
    text = "mail jo@site.org, card 4111 1111 1111 1111, 3 May 2024"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert "[EMAIL]" in tools.TEXT.redact(df).first()["masked"]
    shown = tools.SCREENSHOT.redact(df, on=["contact"]).collect()
    assert "[EMAIL]" in shown[0]["masked"] and "4111" in shown[0]["masked"] and shown[1]["masked"] is None
    secrets = spark.createDataFrame([("x key99", [("TOKEN", 2, 7)])], SPANNED)
    assert tools.SCREENSHOT.redact(secrets, extra="spans").first()["masked"] == "x [TOKEN]"
    with pytest.raises(ValueError):
        tools.CHAT.redact(df, on=["faces"])


def test_names_of_a_long_text_take_as_long_as_those_of_short_ones(spark):
    n, of = 30_000, 60
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.when(k % 3 == 0, "ab").otherwise("1"), k.cast("string")))
    long = spark.range(1).select(F.array_join(words, " ").alias("text"))
    short = spark.range(of).select(F.array_join(F.slice(words, F.col("id").cast("int") * (n // of) + 1, n // of), " ").alias("text")).coalesce(1)

    def took(df):
        df = df.localCheckpoint()
        kept = df.select(F.size(pictures.readable_names(F.col("text"), scan(F.col("text"), "[A-Za-z0-9]+", "NAME"))).alias("n"))
        start = time.time()
        assert kept.agg(F.sum("n")).first()[0] == n // 3
        begun = time.time()
        assert kept.agg(F.sum("n")).first()[0] == n // 3
        return min(begun - start, time.time() - begun)

    assert took(long) < 5 * took(short) + 1
