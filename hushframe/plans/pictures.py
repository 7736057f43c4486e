"""Queries over text read from pictures and bars on pages, both derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import scan
from ..operators import entities, layout, pictures
from ..session import table
from .layouts import PAGE_TEXTS, PARTS, SQL as LAYOUT_SQL, email_rects, page_items, page_texts


def emails_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows an at sign in a document, as a domain, grown to the whole address."""
    text = F.col("text")
    found = scan(text, r"(?<=@)[A-Za-z0-9.-]+", "URL")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(pictures.mended_emails(text, found)).alias("s"))
    return docs.select("doc_id", "s.tag", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def names_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters and digits of a document as names: how many are noise."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", scan(F.col("text"), "[A-Za-z0-9]+", "NAME").alias("found"))
    kept = pictures.readable_names(F.col("text"), F.col("found"))
    docs = docs.select("doc_id", F.size("found").cast("long").alias("all"), F.size(kept).cast("long").alias("kept"))
    return docs.select("doc_id", "kept", (F.col("all") - F.col("kept")).alias("noise"))


def bar_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and bars of each document: the addresses' bars, those at every third place switched
    off, and one bar by hand on each second page."""
    texts = page_texts(spark, sf_dir)
    doc = F.substring_index("id", ":", 1).cast("long").alias("doc_id")
    bars = layout.keyed_bars(layout.merged_rects(email_rects(spark, sf_dir), ["id", "start"]).withColumn("end", F.col("start")), ["id"])
    manual = texts.where(F.substring_index("id", ":", -1).cast("long") % 2 == 1).select("id", F.lit(True).alias("on"))
    all_bars = layout.switched(bars, bars.where("start % 3 = 0").select("key"), manual)
    found = layout.status(texts.select(doc, "text"), all_bars.select(doc, "on"), "doc_id")
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("pages", "bars", "on")], "scan")


def line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each line in its page's text."""
    parts = layout.page_parts(page_items(spark, sf_dir), ["id"])
    return pictures.line_spans(parts, ["id"], "y").select("id", "y", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual length of a page's lines."""
    lines = line_places(spark, sf_dir).select("id", (F.col("end") - F.col("start")).alias("h"))
    return pictures.text_height(lines, ["id"]).select("id", F.col("height").cast("long").alias("height"))


def asked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At signs counted, once per different text, under the model of the document's language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", entities.model_of(F.col("lang")).alias("model"))
    counted = lambda asked: asked.withColumn("found", (F.length("text") - F.length(F.replace("text", F.lit("@"), F.lit("")))).cast("long"))
    return entities.once_per_text(docs, counted).select("doc_id", "model", "found")


QUERIES = {f.__name__: f for f in (emails_mended, names_read, bar_status, line_places, line_lengths, asked_once)}

LINE_PLACES = f'SELECT id, y, min(a) AS start, max(b) AS "end" FROM ({PARTS}) GROUP BY id, y'
SQL = {
    "emails_mended": r"""
SELECT doc_id, 'EMAIL' AS tag, CAST(k - 1 - length(regexp_extract(substr(text, 1, k - 1), '[^\s]*$')) AS BIGINT) AS start,
  CAST(k + length(regexp_extract(substr(text, k + 1), '^[A-Za-z0-9.-]+')) AS BIGINT) AS "end"
FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS k FROM documents WHERE contains(text, '@'))
WHERE substr(text, k, 1) = '@' AND regexp_matches(substr(text, k + 1, 1), '[A-Za-z0-9.-]')""",
    "names_read": """
SELECT doc_id, CAST(len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z][0-9]*[A-Za-z]'))) AS BIGINT) AS kept, CAST(len(ws) AS BIGINT) - kept AS noise
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL)""",
    "bar_status": f"""
WITH bars AS (
  SELECT DISTINCT CAST(split_part(id, ':', 1) AS BIGINT) AS doc_id, id, start, start % 3 <> 0 AS is_on FROM ({LAYOUT_SQL["page_rects"]})
  UNION ALL SELECT CAST(split_part(id, ':', 1) AS BIGINT), id, NULL, true FROM ({PAGE_TEXTS}) WHERE CAST(split_part(id, ':', 2) AS BIGINT) % 2 = 1
), pages AS (SELECT CAST(split_part(id, ':', 1) AS BIGINT) AS doc_id, count(*) AS pages, NOT bool_or(regexp_matches(text, '[^\\s]')) AS scan FROM ({PAGE_TEXTS}) GROUP BY 1)
SELECT p.doc_id, pages, (SELECT count(*) FROM bars b WHERE b.doc_id = p.doc_id) AS bars, (SELECT count(*) FROM bars b WHERE b.doc_id = p.doc_id AND is_on) AS "on", scan FROM pages p""",
    "line_places": LINE_PLACES,
    "line_lengths": f"""
SELECT id, CASE WHEN h = 0 THEN 30 ELSE h END AS height
FROM (SELECT id, list_sort(list("end" - start))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS h FROM ({LINE_PLACES}) GROUP BY id)""",
    "asked_once": """
SELECT doc_id, CASE WHEN lang IN ('es', 'fr', 'de', 'nl', 'zh-Hans', 'zh-Hant', 'ja') THEN 'multi' WHEN lang = 'th' THEN 'th' ELSE 'en' END AS model,
  CAST(length(text) - length(replace(text, '@', '')) AS BIGINT) AS found FROM documents""",
}
