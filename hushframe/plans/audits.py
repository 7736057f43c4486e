"""Queries of the redaction checker, of boxes and of files, over data that Spark derives from
the given tables, and their SQL.

Files: a document's text behind the first bytes of some kind. Words and pixels: embeddings,
each as a word of 64 pixels. Annotations: events, a document per user. Boxes: events, a
picture per user and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..operators import boxes, entities, findings
from ..operators import pictures as pictures_
from ..session import table
from ..streaming import jobs

#: First bytes of files by kind: JPEG, PNG, WebP, PDF, two of videos, and none.
#: Language tags: endings put behind a document's language, and others.
TAGS = ["", "-CH", "-x", "zh-TW", "zh", "zh-Hant-CN", "TH", "ja-JP", "pt-BR", "nl"]
HEADS = ["FFD8FFE0", "89504E47", "524946460000000057454250", "255044462D312E37", "0000001866747970", "1A45DFA3", ""]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode("text", "UTF-8"))
    path = F.concat(F.lit("in/a.b/file"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".mp4"))
    return documents(spark, sf_dir).select("doc_id", files.kind_of(content).alias("kind"), files.accepted(path, "pdf").alias("pdf"), files.accepted(path, "video", F.col("n_chars")).alias("video"), files.output_name(path, "-redacted", "txt", "x-").alias("name"))


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    text, tag = F.col("text"), F.element_at(F.array(*[F.concat("lang", F.lit(end)) for end in TAGS[:3]], *[F.lit(t) for t in TAGS[3:]]), (F.col("doc_id") % len(TAGS) + 1).cast("int"))
    return d.select("doc_id", files.size_text(F.octet_length("text") * 97).alias("size"), files.time_text(F.col("n_chars")).alias("time"), files.shortened(text).alias("short"), files.readable(text).alias("readable"), files.split_words(F.concat(F.lit("camelCase_"), F.col("source"), F.lit(".tagName"))).alias("words"), pictures_.one_line(text).alias("line"), entities.language_of(tag).alias("language"), entities.model_of(tag).alias("model"))


def info() -> Column:
    day = F.format_string("D:%04d%02d%02d120000Z", 2000 + F.col("doc_id") % 25, 1 + F.col("doc_id") % 12, 1 + F.col("doc_id") % 28)
    return F.create_map(F.lit("Title"), F.concat(F.lit("t"), F.col("doc_id").cast("string")), F.lit("Author"), F.col("source"), F.lit("Trapped"), F.lit("no"), F.lit("CreationDate"), day, F.lit("ModDate"), F.when(F.col("doc_id") % 2 == 0, F.substring(day, 1, 6)).otherwise(" "))


def pdf_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(findings.detail_items(info())).alias("line"))


def old_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files saved once, twice or three times, the last title being the current one."""
    again = F.col("doc_id") % 3
    first = F.concat(F.lit("%PDF-1.7 /Title (t"), F.col("doc_id").cast("string"), F.lit(") /Author <"), F.hex(F.encode("source", "ISO-8859-1")), F.lit("> %%EOF\n"))
    second = F.when(again > 0, F.concat(F.lit("/Title (draft \\(a\\) "), F.col("doc_id").cast("string"), F.lit(") %%EOF\n"))).otherwise("")
    third = F.when(again > 1, F.concat(F.lit("/Subject <FEFF00E9 0061> /Keywords ( ) %%EOF"))).otherwise("")
    content = F.encode(F.concat(first, second, third), "ISO-8859-1")
    rows = documents(spark, sf_dir).select("doc_id", findings.versions(content).alias("versions"), findings.old_details(content, findings.detail_items(info())).alias("old"))
    return rows.select("doc_id", F.col("versions").cast("long").alias("versions"), F.explode_outer("old").alias("line"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.element_at(F.array(F.lit(30.0), F.lit(220.0), F.lit(128.0)), (F.floor(F.col("vec_id") / 2) % 3 + 1).cast("int"))
    spread = F.when(F.floor(F.col("vec_id") / 2) % 3 == 2, 100.0).otherwise(8.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", base.alias("base"), spread.alias("spread"), F.explode("embedding").alias("x")).select("vec_id", (F.col("base") + F.col("spread") * F.col("x").cast("double")).alias("light"))


def word_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.looks(pixels(spark, sf_dir), ["vec_id"], F.col("light"))


def look_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of twelve to a line; those in a row that look the same are one phrase."""
    words = word_looks(spark, sf_dir).select(F.floor(F.col("vec_id") / 12).alias("line"), "vec_id", "look", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("str"))
    return findings.phrases(words, ["line"], "vec_id").select("line", "look", "first", "text")


def raster_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as boxes on pages of forty rows of pixels, some of them outside, some wide."""
    k = F.floor(F.col("vec_id") / 8) % 3
    light = F.transform("embedding", lambda v: F.element_at(F.array(F.lit(30.0), F.lit(220.0), F.lit(128.0)), (k + 1).cast("int")) + F.when(k == 2, 100.0).otherwise(8.0) * v.cast("double"))
    # Five vectors' pixels side by side make a row wide enough to be looked at in steps.
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("page"), (F.col("vec_id") % 40).alias("y"), F.flatten(F.array_repeat(light, 5)).alias("light"))
    pages = rows.groupBy("page").agg(F.lit(320).alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    words = e.select((n % 14).alias("page"), n.alias("n"), (n * 7 % 340 - 15).cast("double").alias("x"), (n * 13 % 47 - 4).cast("double").alias("y"), (n * 11 % 301 + 3).cast("double").alias("w"), (n % 9 + 3).cast("double").alias("h"))
    return findings.word_looks(words, rows, pages, ["page"]).select("page", "n", "look")


def file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details, attached files and earlier versions of files that were saved once, twice or three times."""
    again, plain = F.col("doc_id") % 3, F.translate(F.regexp_replace("text", r"[^\x{0}-\x{FF}]", "?"), "()\\", "   ")
    saved = F.concat(F.lit("%%EOF /Subject (draft \\) "), plain, F.lit(") "))
    content = F.encode(F.concat(F.lit("%PDF-1.7 /Title (t"), F.col("doc_id").cast("string"), F.lit(") "), F.repeat(saved, again.cast("int")), F.lit("%%EOF")), "ISO-8859-1")
    attached = F.when(again > 0, F.filter(F.array(F.concat("source", F.lit(".txt")), F.when(again == 2, F.lit("")), F.lit(None).cast("string")), lambda f: f.isNotNull()))
    docs = documents(spark, sf_dir)
    items = findings.findings(findings.document_items(docs, ["doc_id"], info(), attached), ["doc_id"])
    both = items.unionByName(findings.version_findings(docs, ["doc_id"], content, info()))
    return both.select("doc_id", F.col("place").cast("long").alias("place"), "level", "title", "detail", "n", F.array_join("items", "|").alias("items"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    kind = F.element_at(F.array(*[F.lit(s) for s in ("Redact", "Widget", "Text", "Link", "FreeText")]), (k + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", kind.alias("subtype"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).otherwise(" ").alias("contents"),
        F.when(F.col("event_id") % 2 == 0, F.lit("Ann")).otherwise("").alias("title"), F.when(F.col("event_id") % 7 > 0, F.lit("size")).otherwise("").alias("field_name"), F.when(F.col("event_id") % 4 == 0, "Off").otherwise(F.col("event_type")).alias("field_value"),
    )


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each document; at most three items are shown, so that there are others."""
    items = findings.annotation_items(annotations(spark, sf_dir), ["user_id"], "event_id")
    found = findings.findings(items, ["user_id"], "event_id", shown=3)
    return found.select("user_id", F.col("place").cast("long").alias("place"), "level", "title", "n", F.array_join("items", "|").alias("items"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = findings.annotation_items(annotations(spark, sf_dir), ["user_id"], "event_id")
    return findings.report(findings.findings(items, ["user_id"], "event_id", shown=3), ["user_id"], F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".pdf")))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    at = lambda step, most: (F.col("event_id") * step % most).cast("double")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("user"), day.alias("day"), "event_id", at(37, 301).alias("x"), at(53, 211).alias("y"), (at(7, 60) + 20).alias("w"), (at(11, 50) + 20).alias("h"), (at(13, 97) / 97).alias("score"), F.substring(F.concat("event_type", F.lit("!?")), F.lit(1), (F.col("event_id") % 6 + 1).cast("int")).alias("str"))


def faces_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of boxes of the same face the surest."""
    return boxes.strongest(pictures(spark, sf_dir), ["user", "day"], "event_id", boxes.same_face).select("user", "day", "event_id")


def shapes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of shapes that overlap the strongest."""
    return boxes.strongest(pictures(spark, sf_dir), ["user", "day"], "event_id").select("user", "day", "event_id")


def shapes_off_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes without letters: even events are shapes, the others are words."""
    p = pictures(spark, sf_dir)
    return boxes.not_on_text(p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1"), ["user", "day"]).select("event_id")


def face_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.box(*[F.col(c) for c in "xywh"])
    other = boxes.box(F.col("y"), F.col("x"), F.col("h"), F.col("w"))
    rows = pictures(spark, sf_dir).select("event_id", boxes.padded(b, F.lit(300.0), F.lit(200.0), 0.1).alias("p"), boxes.union(b, other).alias("u"), boxes.shared(b, other).alias("s"), boxes.clamped(F.col("score") * 2 - 0.5).alias("c"))
    return rows.select("event_id", *[F.round(f"p.{c}", 6).alias(f"p{c}") for c in "xywh"], *[F.col(f"u.{c}").alias(f"u{c}") for c in "xywh"], F.col("s").cast("double").alias("shared"), F.round("c", 6).alias("clamped"))


def picture_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of pictures of up to some 4,000 pixels a side."""
    d = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") * 37 % 3700 + 300).cast("int").alias("width"), (F.col("doc_id") * 91 % 2600 + 300).cast("int").alias("height"))
    found = d.select("doc_id", F.explode(boxes.tiles(F.col("width"), F.col("height"))).alias("t"))
    return found.select("doc_id", *[F.col(f"t.{c}").cast("long").alias(c) for c in "xywh"])


def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a file as lines; every third has a place."""
    place = F.when(F.col("doc_id") % 3 == 0, F.format_string("+%02d.5%s/", F.col("doc_id") % 90, F.lit("-012.25"))).otherwise("nowhere")
    tags = F.create_map(F.lit("place"), place, F.lit("Make"), F.col("source"), F.lit("imageWidth"), F.lit("12"), F.lit("GPSx"), F.lit("1"), F.lit("userComment_x"), F.col("text"), F.lit("lang"), F.col("lang"))
    rows = documents(spark, sf_dir).select("doc_id", files.tag_report(tags, ["imageWidth"], {"Make": "Camera"}, "place").alias("r"))
    return rows.select("doc_id", F.explode(F.concat("r.location", "r.other")).alias("line"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of windows of an hour, one each quarter of an hour."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").where("ts IS NOT NULL")
    return jobs.windowed(e, "ts", ["event_type"], late=None, step="15 minutes").select(F.unix_seconds("start").alias("start"), "event_type", "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events less than six hours apart."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id").where("ts IS NOT NULL")
    return jobs.in_sessions(e, "ts", ["user_id"], "6 hours", late=None).select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "user_id", "n")


QUERIES = {f.__name__: f for f in (file_kinds, file_texts, pdf_details, old_details, word_looks, look_phrases, raster_looks, file_findings, doc_findings, reports, faces_kept, shapes_kept, shapes_off_text, face_room, picture_tiles, tag_lines, sliding, sessions)}

DOCS = "(SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars FROM documents)"
DAY = "2000 + doc_id % 25, 1 + doc_id % 12, 1 + doc_id % 28"
LOOKS = """SELECT vec_id, CASE WHEN sd < 6 AND mean < 60 THEN 'covered' WHEN sd < 6 THEN 'hidden' END AS look FROM (
  SELECT vec_id, list_avg(l) AS mean, list_stddev_pop(l) AS sd FROM (
    SELECT vec_id, list_transform(embedding, lambda x: [30.0, 220.0, 128.0][CAST((vec_id // 2) % 3 + 1 AS INTEGER)]::DOUBLE + (CASE WHEN (vec_id // 2) % 3 = 2 THEN 100.0 ELSE 8.0 END)::DOUBLE * x::DOUBLE) AS l FROM embeddings))"""
ITEMS = """SELECT user_id, event_id, kind, CASE kind WHEN 0 THEN NULL ELSE text END AS text, kind AS place FROM (
  SELECT user_id, event_id,
    CASE WHEN k = 0 THEN 2 WHEN k = 1 THEN CASE WHEN field_value <> 'Off' AND trim(coalesce(field_value, '')) <> '' THEN 6 END WHEN k <> 3 AND trim(contents) <> '' THEN 5 END AS kind,
    CASE WHEN k = 0 THEN contents WHEN k = 1 THEN field_name || ': ' || field_value WHEN title <> '' THEN title || ': ' || contents ELSE contents END AS text
  FROM (SELECT user_id, event_id, event_id % 5 AS k, CASE WHEN event_id % 3 > 0 THEN 'note ' || event_id ELSE ' ' END AS contents, CASE WHEN event_id % 2 = 0 THEN 'Ann' ELSE '' END AS title,
      CASE WHEN event_id % 7 > 0 THEN 'size' ELSE 'Field' END AS field_name, CASE WHEN event_id % 4 = 0 THEN 'Off' ELSE event_type END AS field_value FROM events)) WHERE kind IS NOT NULL"""
FOUND = f"""SELECT user_id, CAST(place AS BIGINT) AS place, CASE WHEN place = 2 THEN 'leak' ELSE 'check' END AS level,
  CASE place WHEN 2 THEN 'Redactions marked but not applied' WHEN 5 THEN 'Comments and notes' ELSE 'Form fields with values' END AS title,
  CASE place WHEN 2 THEN 'Someone marked these areas for redaction, but the text under them is still in the file.' WHEN 5 THEN 'Comments are saved in the file and often contain names.' ELSE 'Filled form fields are saved in the file.' END AS detail,
  count(*) AS n, list(text ORDER BY event_id, text)[1:3] AS items, CASE WHEN count(*) > 3 THEN '…and ' || (count(*) - 3) || ' more' END AS more
FROM ({ITEMS}) GROUP BY user_id, place"""
PICTURES = """SELECT user_id % 50 AS "user", CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_id, CAST(event_id * 37 % 301 AS DOUBLE) AS x, CAST(event_id * 53 % 211 AS DOUBLE) AS y,
  CAST(event_id * 7 % 60 + 20 AS DOUBLE) AS w, CAST(event_id * 11 % 50 + 20 AS DOUBLE) AS h, CAST(event_id * 13 % 97 AS DOUBLE) / 97 AS score, substr(event_type || '!?', 1, CAST(event_id % 6 + 1 AS INTEGER)) AS str FROM events"""


def shared_sql(a: str, b: str) -> str:
    w = f"least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)"
    h = f"least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN ({w}) * ({h}) ELSE 0 END)"


def holds_sql(b: str, a: str) -> str:
    return f"({a}.x + {a}.w / 2 > {b}.x AND {a}.x + {a}.w / 2 < {b}.x + {b}.w AND {a}.y + {a}.h / 2 > {b}.y AND {a}.y + {a}.h / 2 < {b}.y + {b}.h)"


def strongest_sql(same: str) -> str:
    return f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY "user", day ORDER BY score DESC, event_id) AS n FROM ({PICTURES})),
f AS (
  SELECT "user", day, n, [{{'x': x, 'y': y, 'w': w, 'h': h, 'e': event_id}}] AS kept FROM p WHERE n = 1
  UNION ALL
  SELECT p."user", p.day, p.n, CASE WHEN len(list_filter(kept, lambda k: {same})) > 0 THEN kept ELSE list_append(kept, {{'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'e': p.event_id}}) END
  FROM f JOIN p ON p."user" = f."user" AND p.day = f.day AND p.n = f.n + 1
), last AS (SELECT "user", day, arg_max(kept, n) AS kept FROM f GROUP BY "user", day)
SELECT "user", day, unnest(list_transform(kept, lambda k: k.e)) AS event_id FROM last"""


COMMON, LEAST = shared_sql("p", "k"), "least(p.w * p.h, k.w * k.h)"
POSITIONS = "CASE WHEN {v} <= 960 THEN [0] ELSE list_concat(list_transform(range(0, CAST(ceil(({v} - 960) / 720.0) AS BIGINT)), lambda i: i * 720), [{v} - 960]) END"
SQL = {
    "file_kinds": f"""
SELECT doc_id, CASE WHEN c LIKE 'FFD8%' THEN 'jpeg' WHEN c LIKE '89504E47%' THEN 'png' WHEN c LIKE '52494646________57454250%' THEN 'webp' WHEN c LIKE '255044462D%' THEN 'pdf'
    WHEN substr(c, 9, 8) IN ('66747970', '6D6F6F76', '6D646174', '77696465') OR c LIKE '1A45DFA3%' THEN 'video' END AS kind,
  doc_id % 2 = 0 AS pdf, doc_id % 2 = 1 AND n_chars <= 600 AS video, 'x-file' || doc_id || '-redacted.txt' AS name
FROM (SELECT *, {HEADS}[CAST(doc_id % 7 + 1 AS INTEGER)] || hex(encode(text)) AS c FROM {DOCS})""",
    "file_texts": rf"""
SELECT doc_id, CASE WHEN b < 1048576 THEN greatest(1, CAST(floor(b / 1024.0 + 0.5) AS BIGINT)) || ' KB' ELSE printf('%.1f MB', b / 1024.0::DOUBLE / 1024.0::DOUBLE) END AS size,
  (n_chars // 60) || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS time, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '…' ELSE t END AS short,
  CASE WHEN regexp_matches(r, '[A-Za-z0-9][A-Za-z0-9]') THEN r ELSE '' END AS readable, 'camel Case ' || source || ' tag Name' AS words, replace(t, chr(10), ' ') AS line, language, CASE language WHEN 'en' THEN 'en' WHEN 'th' THEN 'th' ELSE 'multi' END AS model
FROM (SELECT *, CASE WHEN k IN (3, 5) THEN 'zh-Hant' WHEN k = 4 THEN 'zh-Hans' WHEN k = 6 THEN 'th' WHEN k = 7 THEN 'ja' WHEN k = 9 THEN 'nl' WHEN k < 3 AND lang IN ('en', 'es', 'fr', 'de', 'nl', 'ja', 'th') THEN lang ELSE 'en' END AS language
  FROM (SELECT *, doc_id % 10 AS k, text AS t, trim(regexp_replace(text, '[\x00-\x1f\x{{FFFD}}]', '', 'g')) AS r, strlen(text) * 97 AS b FROM {DOCS}))""",
    "pdf_details": f"""
SELECT doc_id, unnest(list_filter(['Title: t' || doc_id, CASE WHEN trim(source) <> '' THEN 'Author: ' || source END, printf('Created: %04d-%02d-%02d', {DAY}), CASE WHEN doc_id % 2 = 0 THEN printf('Changed: %04d', 2000 + doc_id % 25) END], lambda x: x IS NOT NULL)) AS line FROM {DOCS}""",
    "old_details": f"""
SELECT doc_id, 1 + doc_id % 3 AS versions, unnest(CASE doc_id % 3 WHEN 0 THEN [NULL] WHEN 1 THEN ['Title: draft (a) ' || doc_id] ELSE ['Title: draft (a) ' || doc_id, 'Subject: éa'] END) AS line FROM {DOCS}""",
    "word_looks": LOOKS,
    "look_phrases": f"""
WITH w AS (SELECT vec_id // 12 AS line, vec_id, look FROM ({LOOKS})),
r AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY vec_id) AS run FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY line ORDER BY vec_id) > 1 AND lag(look) OVER (PARTITION BY line ORDER BY vec_id) IS NOT DISTINCT FROM look THEN 0 ELSE 1 END AS new FROM w))
SELECT line, look, min(vec_id) AS first, string_agg('w' || vec_id, ' ' ORDER BY vec_id) AS text FROM r WHERE look IS NOT NULL GROUP BY line, run, look""",
    "raster_looks": """
WITH r AS MATERIALIZED (SELECT vec_id // 40 AS page, vec_id % 40 AS y, list_transform(embedding, lambda v: [30.0, 220.0, 128.0][CAST((vec_id // 8) % 3 + 1 AS INTEGER)]::DOUBLE + (CASE WHEN (vec_id // 8) % 3 = 2 THEN 100.0 ELSE 8.0 END)::DOUBLE * v::DOUBLE) AS l FROM embeddings),
g AS (SELECT page, 320 AS wide, max(y) + 1 AS high FROM r GROUP BY page),
b AS (SELECT event_id % 14 AS page, event_id AS n, event_id * 7 % 340 - 15 AS x, event_id * 13 % 47 - 4 AS y, event_id * 11 % 301 + 3 AS w, event_id % 9 + 3 AS h FROM events),
m AS (SELECT b.*, wide, high, greatest(0, floor(x + w * 0.2::DOUBLE))::INT AS x0, least(wide, ceil(x + w * (1 - 0.2::DOUBLE)))::INT AS x1, greatest(0, floor(b.y + h * 0.3::DOUBLE))::INT AS y0, least(high, ceil(b.y + h * (1 - 0.3::DOUBLE)))::INT AS y1 FROM b JOIN g USING (page)),
p AS (SELECT m.page, n, list_transform(range(x0, x1, greatest(1, (x1 - x0) // 120)), lambda i: l[i % 64 + 1]) AS l FROM m JOIN r ON r.page = m.page AND r.y >= y0 AND r.y < y1 WHERE x1 - x0 >= 2 AND y1 - y0 >= 2),
k AS (SELECT page, n, avg(v) AS mean, stddev_pop(v) AS sd FROM (SELECT page, n, unnest(l) AS v FROM p) GROUP BY ALL)
SELECT m.page, m.n, CASE WHEN x + w < 0 OR y + h < 0 OR x > wide OR y > high THEN 'outside' WHEN sd < 6 AND mean < 60 THEN 'covered' WHEN sd < 6 THEN 'hidden' END AS look FROM m LEFT JOIN k USING (page, n)""",
    "file_findings": f"""
WITH d AS (SELECT *, doc_id % 3 AS k, list_filter(['Title: t' || doc_id, CASE WHEN trim(source) <> '' THEN 'Author: ' || source END, printf('Created: %04d-%02d-%02d', {DAY}), CASE WHEN doc_id % 2 = 0 THEN printf('Changed: %04d', 2000 + doc_id % 25) END], lambda x: x IS NOT NULL) AS details FROM {DOCS})
SELECT doc_id, 8::BIGINT AS place, 'check' AS level, 'Document details (metadata)' AS title, 'These details are saved in the file and show in PDF apps.' AS detail, len(details)::BIGINT AS n, array_to_string(details, '|') AS items FROM d
UNION ALL SELECT doc_id, 7, 'check', 'Attached files', 'Files attached inside the PDF are shared with it.', k, source || '.txt' || CASE WHEN k = 2 THEN '|Attachment' ELSE '' END FROM d WHERE k > 0
UNION ALL SELECT doc_id, 3, 'leak', (k + 1) || ' saved versions in one file', 'The file was saved over without being rebuilt, so earlier versions are still inside it. These details from an earlier version are still readable:', 1,
  'Subject: draft ) ' || translate(regexp_replace(text, '[^\\x00-\\xff]', '?', 'g'), '()' || chr(92), '   ') FROM d WHERE k > 0""",
    "doc_findings": f"SELECT user_id, place, level, title, n, array_to_string(items, '|') || coalesce('|' || more, '') AS items FROM ({FOUND})",
    "reports": f"""
SELECT user_id, 'Redaction check: u' || user_id || '.pdf' || CASE WHEN bool_or(level = 'leak') THEN '' ELSE chr(10) || chr(10) || 'No leaks found.' END || chr(10) || chr(10)
  || string_agg('[' || upper(level) || '] ' || title || chr(10) || detail || chr(10) || '  - ' || array_to_string(items, chr(10) || '  - ') || coalesce(chr(10) || '  - ' || more, ''), chr(10) || chr(10) ORDER BY place) AS report
FROM ({FOUND}) GROUP BY user_id""",
    "faces_kept": strongest_sql(f"{COMMON} > 0 AND ({COMMON} / (p.w * p.h + k.w * k.h - {COMMON}) > 0.3 OR {COMMON} / {LEAST} > 0.5 OR {holds_sql('p', 'k')} OR {holds_sql('k', 'p')})"),
    "shapes_kept": strongest_sql(f"{COMMON} / {LEAST} > 0.3"),
    "shapes_off_text": f"""
SELECT s.event_id FROM ({PICTURES}) s WHERE s.event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ({PICTURES}) w WHERE w.event_id % 2 = 1 AND w."user" = s."user" AND w.day = s.day
  AND {shared_sql('w', 's')} >= w.w * w.h * 0.15 AND (NOT {holds_sql('s', 'w')} OR length(regexp_replace(w.str, '[^\\p{{L}}\\p{{N}}]', '', 'g')) > 3))""",
    "face_room": f"""
SELECT event_id, round(px, 6) AS px, round(py, 6) AS py, round(least(300.0::DOUBLE, x + w * 1.28::DOUBLE) - px, 6) AS pw, round(least(200.0::DOUBLE, y + h * 1.22::DOUBLE) - py, 6) AS ph,
  least(x, y) AS ux, least(x, y) AS uy, greatest(x + w, y + h) - least(x, y) AS uw, greatest(y + h, x + w) - least(x, y) AS uh,
  CAST(CASE WHEN least(x + w, y + h) > greatest(x, y) THEN (least(x + w, y + h) - greatest(x, y)) * (least(y + h, x + w) - greatest(y, x)) ELSE 0 END AS DOUBLE) AS shared,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score * 2 - 0.5::DOUBLE)), 6) AS clamped
FROM (SELECT *, greatest(0.0::DOUBLE, x - w * 0.28::DOUBLE) AS px, greatest(0.0::DOUBLE, y - h * 0.45::DOUBLE) AS py FROM ({PICTURES}))""",
    "picture_tiles": f"""
WITH d AS (SELECT doc_id, doc_id * 37 % 3700 + 300 AS width, doc_id * 91 % 2600 + 300 AS height FROM documents),
t AS (SELECT doc_id, width, height, x, unnest(ys) AS y FROM (SELECT *, unnest({POSITIONS.format(v='width')}) AS x, {POSITIONS.format(v='height')} AS ys FROM d WHERE greatest(width, height) > 1248))
SELECT doc_id, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, width AS w, height AS h FROM d
UNION ALL SELECT doc_id, x, y, least(960, width - x), least(960, height - y) FROM t""",
    "tag_lines": f"""
SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 3 = 0 THEN printf('GPS location: %.5f, -12.25000', (doc_id % 90) + 0.5::DOUBLE) END, CASE WHEN trim(source) <> '' THEN 'Camera: ' || trim(source) END,
  CASE WHEN trim(c) <> '' THEN 'user Comment x: ' || CASE WHEN length(trim(c)) > 120 THEN substr(trim(c), 1, 117) || '…' ELSE trim(c) END END, CASE WHEN trim(lang) <> '' THEN 'lang: ' || trim(lang) END], lambda x: x IS NOT NULL)) AS line
FROM (SELECT *, text AS c FROM {DOCS})""",
    "sliding": """
SELECT start, event_type, count(*) AS n FROM (
  SELECT event_type, unnest(range(CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 - 2700, CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 + 1, 900)) AS start FROM events WHERE ts IS NOT NULL) GROUP BY ALL""",
    "sessions": """
WITH s AS (SELECT user_id, epoch_us(ts) AS u, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL))
SELECT min(u) AS start, max(u) + 21600000000 AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
}
