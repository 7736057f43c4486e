"""Queries of screen layout and turned text over data that Spark derives from the given tables.

Pictures: events, a screen of 400 by 900 per user and day; every seventh event is an area, the others are
words and lines. Turned pages: the items of a document's pages, each at one of four angles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import boxes, intervals, layout, pictures, screens
from ..session import table
from .layouts import EMAIL, PARTS, PAGE_TEXTS, pages
from .texts import COALESCED_SQL, exploded, spans_sql, texts

#: What a line of a screen says, by its event.
SAID = ["Ann Lee", "6 members", "zuletzt online", "x", "王", "Équipe", "lid van", "lidmaat", "escribiendo…", "กำลังพิมพ์", "7 8", "Leden"]
#: Angles by item: the first four numbers of a transform.
TURNS = [(10, 0, 0, 10), (0, 10, -10, 0), (6, 8, -8, 6), (-10, 0, 0, -10)]


def spans_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans of four rules joined, as rows of a table."""
    by = {r.name: r for r in R.GENERAL}
    found = F.flatten(R.detect(F.col("text"), [by[n] for n in ("assigned", "email", "card", "ip")]))
    spans = exploded(texts(spark, sf_dir).withColumn("s", found), "s")
    joined = intervals.coalesced(spans, ["id"]).select("id", "start", "end")
    return joined.join(texts(spark, sf_dir), "id").select("id", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))


def turned_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email addresses of page text back to boxes, of items at angles, in two fonts."""
    turn = {c: lambda n, i=i: F.element_at(F.array(*[F.lit(float(t[i])) for t in TURNS]), (n % len(TURNS) + 1).cast("int")) for i, c in enumerate("abcd")}
    letters = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: F.char(c))
    fonts = spark.range(2).select(F.col("id").alias("font"), F.map_from_arrays(letters, F.transform(letters, lambda c: (F.ascii(c) % 5 + 3 + F.col("id")).cast("double"))).alias("widths"))
    placed = pages(spark, sf_dir, turn | {"font": lambda n: n % 3})
    return layout.page_boxes(placed, ["id"], EMAIL.spans, fonts).select("id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    at = lambda step, most: (n * step % most).cast("double")
    said = F.element_at(F.array(*[F.lit(s) for s in SAID]), (n % len(SAID) + 1).cast("int"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("user"), "event_id", at(37, 401).alias("x"), at(53, 151).alias("y"), (at(7, 90) + 10).alias("w"), (at(11, 30) + 10).alias("h"), said.alias("text"), (n % 7 == 0).alias("area"))


def words_off_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words below the status bar whose middle lies in no profile picture."""
    s = screen(spark, sf_dir)
    words = pictures.below_status(s.where("NOT area"), F.lit(400), F.lit(900))
    return boxes.not_inside(words, s.where("area"), ["user"]).select("user", "event_id")


def head_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the head of a screen that name a chat."""
    return pictures.head_names(screen(spark, sf_dir), F.lit(400), F.lit(900)).select("event_id", "text")


def face_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to cover of small and large faces."""
    b = boxes.box(*[F.col(c) for c in "xywh"])
    return screen(spark, sf_dir).select("event_id", boxes.face_cover(b, F.lit(400), F.lit(900)).alias("c")).select("event_id", *[F.round(f"c.{c}", 6).alias(c) for c in "xywh"])


def hidden_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes of a user are hidden: names, faces and others."""
    n = F.col("event_id")
    tagged = screen(spark, sf_dir).withColumns({"tag": F.when(n % 5 < 3, "NAME").when(n % 5 == 3, "FACE").when(n % 2 == 0, "CARD"), "on": n % 4 > 0})
    return pictures.hidden_counts(tagged, ["user"])


def dark_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as regions of 64 pixels: which ones are dark."""
    light = F.transform("embedding", lambda v: F.lit(110.0) + v.cast("double") * 200)
    return table(spark, sf_dir, "embeddings").select("vec_id", screens.is_dark(light).alias("dark"))


def faces_at_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as faces found at checks of a quarter second: what every second check tells, in all."""
    found = screen(spark, sf_dir).withColumn("n", F.floor(F.col("event_id") / 3) % 50 + 1)
    return screens.face_checks(found).groupBy("user").agg(F.count(F.lit(1)).alias("faces"), F.count_distinct("n").alias("checks"))


QUERIES = {f.__name__: f for f in (spans_joined, turned_rects, words_off_pictures, head_names, face_covers, hidden_names, dark_screens, faces_at_checks)}

SCREEN = f"""(SELECT user_id % 40 AS "user", event_id, CAST(event_id * 37 % 401 AS DOUBLE) AS x, CAST(event_id * 53 % 151 AS DOUBLE) AS y, CAST(event_id * 7 % 90 + 10 AS DOUBLE) AS w, CAST(event_id * 11 % 30 + 10 AS DOUBLE) AS h,
  {SAID!r}[CAST(event_id % {len(SAID)} + 1 AS INTEGER)] AS text, event_id % 7 = 0 AS area FROM events)"""


def wide(t: str) -> str:
    """A text's width in a font: letters by their number, others as the mean letter; all alike without a font."""
    letter = "(unicode(c) % 5 + 3 + font)::DOUBLE"
    return f"list_sum(list_transform(list_filter(string_split({t}, ''), lambda c: c <> ''), lambda c: CASE WHEN font = 2 THEN 1.0::DOUBLE WHEN c BETWEEN 'a' AND 'z' AND length(c) = 1 THEN {letter} ELSE mean + font END))"


TURN = {c: f"{[t[i] for t in TURNS]}[CAST(n % 4 + 1 AS INTEGER)]::DOUBLE" for i, c in enumerate("abcd")}
CORNERS = ["left_, -2.8", "left_, 9.5", "right_, -2.8", "right_, 9.5"]


def corner(o: str, along: str, up: str, uv: str) -> str:
    u, v = uv.split(", ")
    return f"{o} + {along} / 10 * {u} + {up} / 10 * ({v})"


def side(pick: str, o: str, along: str, up: str) -> str:
    return f"round(CAST({pick}({', '.join(corner(o, along, up, c) for c in CORNERS)}) AS DOUBLE), 3)"


SQL = {
    "dark_screens": "SELECT vec_id, list_avg(list_transform(list_filter(embedding, lambda v, i: (i - 1) % 4 = 0), lambda v: 110.0::DOUBLE + v::DOUBLE * 200)) < 110 AS dark FROM embeddings",
    "faces_at_checks": f"""SELECT "user", count(*) AS faces, count(DISTINCT n) AS checks FROM (SELECT *, (event_id // 3) % 50 + 1 AS n FROM {SCREEN}) WHERE (n - 1) % 2 = 0 GROUP BY ALL""",
    "spans_joined": COALESCED_SQL,
    "turned_rects": f"""
WITH m AS (SELECT avg(l % 5 + 3) AS mean FROM range(97, 123) r(l)),
h AS (SELECT s.id, s.start, p.n, x, y, width, str, n % 3 AS font, mean, {", ".join(f"{v} AS t{c}" for c, v in TURN.items())}, substr(str, 1, greatest(s.start, a) - a) AS one, substr(str, 1, least(s."end", b) - a) AS two
  FROM ({spans_sql("email", PAGE_TEXTS)}) s JOIN ({PARTS}) p ON s.id = p.id AND s.start < p.b AND s."end" > p.a, m),
k AS (SELECT *, coalesce({wide("one")}, 0) / {wide("str")} * width - 2 AS left_, {wide("two")} / {wide("str")} * width + 2 AS right_ FROM h)
SELECT id, start, CAST(n AS BIGINT) AS n, {side("least", "x", "ta", "tc")} AS x0, {side("least", "y", "tb", "td")} AS y0, {side("greatest", "x", "ta", "tc")} AS x1, {side("greatest", "y", "tb", "td")} AS y1 FROM k""",
    "words_off_pictures": f"""
SELECT "user", event_id FROM {SCREEN} w WHERE NOT area AND y + h / 2 > 900 * 0.045::DOUBLE AND NOT EXISTS (
  SELECT 1 FROM {SCREEN} a WHERE a.area AND a."user" = w."user" AND w.x + w.w / 2 > a.x AND w.x + w.w / 2 < a.x + a.w AND w.y + w.h / 2 > a.y AND w.y + w.h / 2 < a.y + a.h)""",
    "head_names": f"""
SELECT event_id, text FROM {SCREEN} WHERE y + h / 2 BETWEEN 900 * 0.045::DOUBLE AND 900 * 0.095::DOUBLE AND x >= 400 * 0.15::DOUBLE AND x + w <= 400 * (1 - 0.15::DOUBLE)
  AND text NOT IN ('6 members', 'zuletzt online', 'lid van', 'escribiendo…', 'กำลังพิมพ์', 'Leden', 'x', '7 8')""",
    "face_covers": f"""
SELECT event_id, round(CASE WHEN small THEN greatest(0, x - w / 2) ELSE px END, 6) AS x, round(CASE WHEN small THEN greatest(0, y + h / 2 - w) ELSE py END, 6) AS y,
  round(CASE WHEN small THEN w * 2 ELSE least(400, x + w * 1.23::DOUBLE) - px END, 6) AS w, round(CASE WHEN small THEN w * 2 ELSE least(900, y + h * 1.17::DOUBLE) - py END, 6) AS h
FROM (SELECT *, w < 400 * 0.08::DOUBLE AS small, greatest(0, x - w * 0.23::DOUBLE) AS px, greatest(0, y - h * 0.4::DOUBLE) AS py FROM {SCREEN})""",
    "hidden_names": f"""
SELECT "user", count(*) FILTER (s) AS hidden, count(DISTINCT lower(text)) FILTER (s AND k < 3) AS names, count(*) FILTER (s AND k = 3) AS faces, count(*) FILTER (s AND k = 4) > 0 AS more
FROM (SELECT *, event_id % 5 AS k, event_id % 4 > 0 AS s FROM {SCREEN}) GROUP BY ALL""",
}
