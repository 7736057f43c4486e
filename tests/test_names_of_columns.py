"""Tables whose columns are named like ones that operators make for themselves."""

from hushframe.operators import intervals, series, tracking, words


def test_as_of(spark):
    kind = "k long, t timestamp, side string, hit string, last string"
    left = spark.sql("SELECT 1L AS k, TIMESTAMP '2024-01-01 00:00:02' AS t, 'a' AS side, 'b' AS hit, 'c' AS last, 'd' AS side_")
    right = spark.sql("SELECT 1L AS k, TIMESTAMP '2024-01-01 00:00:01' AS t, 7 AS hits, 'z' AS side, 'z' AS last")
    found = series.as_of(left, right, ["k"], "t", "hits")
    assert [(r["side"], r["hit"], r["last"], r["side_"], r["hits"]) for r in found.collect()] == [("a", "b", "c", "d", 7)]
    assert series.as_of(spark.createDataFrame([], kind), right, ["k"], "t", "hits").count() == 0


def test_kept_tracks(spark):
    rows = spark.createDataFrame([(1, 0, 0.1, "x"), (1, 0, 0.1, "y"), (2, 0, 0.1, "z"), (3, 0, 0.95, None)], "track long, v long, score double, n string")
    assert sorted(r["n"] or "-" for r in tracking.kept(rows, ["v", "track"], "n").collect()) == ["-", "x", "y"]


def test_word_parts(spark):
    rows = spark.createDataFrame([("p", 0, 0, "a", 0.0, 10.0, 10.0, "q"), ("p", 1, 0, "b", 12.0, 10.0, 10.0, "r")], "id string, n long, line long, str string, x double, w double, h double, sep string")
    assert [(r["sep"], r["start"], r["end"]) for r in words.word_parts(rows, "id").orderBy("n").collect()] == [("q", 0, 1), ("r", 2, 3)]


def test_overlapping(spark):
    left = spark.createDataFrame([(1, 0, 5000, "l")], "k long, a long, b long, bin string")
    right = spark.createDataFrame([(1, 4000, 9000, "r"), (1, 5000, 5001, "s")], "k long, c long, d long, bin_ string")
    found = intervals.overlapping(left, right, ["k"], ("a", "b"), ("c", "d")).collect()
    assert [(r["bin"], r["bin_"]) for r in found] == [("l", "r")]
