"""Interval joins and unions as tables, centers in areas, heads of screens, turned items, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hushframe.functions.spans import coalesce
from hushframe.operators import boxes, intervals, layout, pictures, screens

PARTS = "p int, n int, start int, end int, x double, y double, width double, size double, str string, font string, a double, b double, c double, d double"


@pytest.mark.parametrize("size", [4, 2048])
def test_overlapping_pairs(spark, size):
    rng = random.Random(size)
    make = lambda n: [(rng.choice([1, 1, 1, 2, None]), s, s + rng.choice([0, 1, 3, 40])) for s in (rng.randrange(100) for _ in range(n))]
    a, b = make(150), make(150)
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "k int, s int, e int, i int")
    right = spark.createDataFrame([(*r, i) for i, r in enumerate(b)], "k int, u int, v int, j int")
    got = sorted((r["i"], r["j"]) for r in intervals.overlapping(left, right, ["k"], ("s", "e"), ("u", "v"), size).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] is not None and x[0] == y[0] and x[1] < y[2] and x[2] > y[1])


@pytest.mark.parametrize("size", [3, 16, 2048])
def test_coalesced_like_the_array_form(spark, size):
    rng = random.Random(size)
    rows = [(d, [(rng.choice("ABC"), s, s + rng.choice([1, 2, 5, 25])) for s in (rng.randrange(rng.choice([20, 120])) for _ in range(rng.randint(0, 15)))]) for d in range(120)]
    df = spark.createDataFrame(rows, "d int, s array<struct<tag:string,start:int,end:int>>")
    want = {(r["d"], *x) for r in df.select("d", coalesce(F.col("s")).alias("c")).collect() for x in r["c"]}
    got = intervals.coalesced(df.select("d", F.explode("s").alias("x")).select("d", "x.*"), ["d"], size=size).select("d", "tag", "start", "end").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert intervals.coalesced(df.where("false").select("d", F.lit("t").alias("tag"), F.lit(1).alias("start"), F.lit(2).alias("end")), ["d"]).count() == 0


def test_one_text_of_most_spans_is_many_tasks_work(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("d"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 4).cast("int").alias("end"), F.lit("T").alias("tag"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = intervals.overlapping(rows.select("d", "start", "end"), rows.select("d", F.col("start").alias("u"), F.col("end").alias("v")), ["d"], of_right=("u", "v"))
        sizes = [r["n"] for r in met.where("d = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert intervals.coalesced(rows, ["d"]).where("d = 0").count() == 30_000


def test_not_inside(spark):
    rng = random.Random(6)
    make = lambda n, most: [(rng.choice([1, 2, None]), i, rng.uniform(-50, 600), rng.uniform(-50, 600), rng.uniform(0, most), rng.uniform(0, most)) for i in range(n)]
    words, areas = [*make(300, 30), (1, 900, None, 1.0, 1.0, 1.0), (1, 901, 90.0, 90.0, 20.0, 20.0)], [*make(12, 300), (1, 50, 100.0, 100.0, 9.0, 9.0)]
    kind = "p int, i int, x double, y double, w double, h double"
    got = {r["i"] for r in boxes.not_inside(spark.createDataFrame(words, kind), spark.createDataFrame(areas, kind), ["p"]).collect()}
    inside = lambda o, a: o[0] is not None and o[0] == a[0] and o[2] is not None and a[2] < o[2] + o[4] / 2 < a[2] + a[4] and a[3] < o[3] + o[5] / 2 < a[3] + a[5]
    assert got == {o[1] for o in words if not any(inside(o, a) for a in areas)} and 901 in got


def test_heads_and_counts(spark):
    kind = "i int, x double, y double, w double, h double, text string"
    texts = ["Ann", "last seen", "Últ. vez", "x últ. vez", "zx", "7", "王", "Membre", "Membres", "online", "onlines", "écrit", "vu à"]
    lines = spark.createDataFrame([(i, 100.0, 60.0, 100.0, 10.0, t) for i, t in enumerate(texts)] + [(90, 10.0, 60.0, 9.0, 9.0, "Ann"), (91, 100.0, 60.0, 300.0, 9.0, "Ann"), (92, 100.0, 10.0, 9.0, 9.0, "Ann"), (93, 100.0, 90.0, 9.0, 9.0, "Ann")], kind)
    got = {r["text"] for r in pictures.head_names(lines, F.lit(400), F.lit(900)).collect()}
    # A word border is one of plain letters, so "écrit" has none before it, and "vu à" none behind it.
    assert got == {"Ann", "Últ. vez", "x últ. vez", "zx", "王", "onlines", "écrit", "vu à"}
    counted = spark.createDataFrame([(1, "NAME", "Ann", True), (1, "NAME", "ann", True), (1, "NAME", "Bob", False), (1, "FACE", None, True), (2, "CARD", "4", True), (3, None, None, False)], "p int, tag string, text string, on boolean")
    assert {tuple(r) for r in pictures.hidden_counts(counted, ["p"]).collect()} == {(1, 3, 1, 1, False), (2, 1, 0, 0, True), (3, 0, 0, 0, False)}


def test_turned_items(spark):
    rng, rows, spans = random.Random(8), [], []
    widths = {"i": 2.0, "m": 8.0, "e": 5.0}
    for n in range(40):
        text = "".join(rng.choice("ime") for _ in range(rng.randint(1, 12)))
        turn, size = rng.uniform(0, 6.3), rng.choice([8.0, 12.0])
        rows.append((1, n, 100 * n, 100 * n + len(text), rng.uniform(0, 500), rng.uniform(0, 500), rng.uniform(20, 90), size, text, rng.choice(["f", "g"]), 3 * math.cos(turn), 3 * math.sin(turn), -size * math.sin(turn), size * math.cos(turn)))
        first = rng.randrange(len(text))
        spans.append((1, 100 * n + first, 100 * n + rng.randint(first + 1, len(text))))
    fonts = spark.createDataFrame([("f", widths)], "font string, widths map<string,double>")
    got = layout.span_rects(spark.createDataFrame(spans, "p int, start int, end int"), spark.createDataFrame(rows, PARTS), ["p"], [], fonts).collect()
    assert len(got) == len(rows)
    for r in got:
        _, _, at, _, x, y, width, size, text, font, a, b, c, d = rows[r["n"]]
        measure = lambda t: sum(widths[k] if font == "f" else 1.0 for k in t)  # noqa: B023, E731
        u0, u1 = (measure(text[: k - at]) / measure(text) * width for k in (r["start"], r["end"]))
        corners = [(x + a / 3 * u + c / size * v, y + b / 3 * u + d / size * v) for u in (u0 - 0.2 * size, u1 + 0.2 * size) for v in (-0.28 * size, 0.95 * size)]
        want = [f(p[i] for p in corners) for f in (min, max) for i in (0, 1)]
        assert [r["x0"], r["y0"], r["x1"], r["y1"]] == pytest.approx(want)


def test_dark_regions_and_face_checks(spark):
    rows = [([100.0] + [255.0] * 3 + [119.0],), ([100.0] + [0.0] * 3 + [120.0],), ([],), (None,)]
    assert [r["d"] for r in spark.createDataFrame(rows, "l array<double>").select(screens.is_dark(F.col("l")).alias("d")).collect()] == [True, False, False, False]
    assert [r["n"] for r in screens.face_checks(spark.range(1, 7).toDF("n")).collect()] == [1, 3, 5]
