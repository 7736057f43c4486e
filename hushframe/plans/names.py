"""Queries of terms given as a table and of name models: tokens back to places, and two rounds.

Lines of documents are a model's texts; their words in lower case are its tokens, and capitalized
words, scored by their letters, its names. Terms are words of every fiftieth document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import matches, placed
from ..operators import entities
from ..operators import terms as terms_
from ..session import table

BLANKS = r"[\x20\x09-\x0D]+"
#: What counts as a name: a capitalized word, or two over a line end.
NAME = r"[A-Z][a-z]+(?:\n[A-Z][a-z]+)?"


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's decoded words, marked as pieces, put back to their places in each line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "chunk"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("chunk", BLANKS, -1)).alias("n", "w")).where("w <> ''")
    tokens = words.withColumns({"word": F.concat(F.lit("##▁"), F.lower("w")), "entity": F.lit("I-PER"), "score": F.lit(1.0)})
    found = entities.with_places(tokens, ["doc_id", "line"], chunks=lines)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lower("value").alias("word"))


def names_in_text(asked: DataFrame) -> DataFrame:
    """In place of a model: names by their letters."""

    def name(s):
        v = s["value"]
        kind = F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG"), F.lit("MISC")), (F.length(v) % 4 + 1).cast("int"))
        return F.struct(kind.alias("label"), s["start"].alias("start"), s["end"].alias("end"), ((F.length(v) * 7 + F.ascii(v) * 13) % 100 / 100).alias("score"))

    hits = F.transform(F.filter(F.array(matches(F.col("text"), NAME)), lambda m: m.isNotNull()), placed)
    return asked.withColumn("found", F.transform(F.flatten(hits), name))


def names_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of whole texts and, under the English model, of lines alone, cut at line ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("multi").alias("model"))
    return entities.in_two_rounds(docs, ["doc_id"], names_in_text).select("doc_id", "label", "start", "end", F.round("score", 2).alias("score"))


def upper(word: Column) -> Column:
    """A word in capitals, letter by letter: one whose capital is two letters (``ß``) stays as it is."""
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", BLANKS, -1)
    two = F.when(F.lower(F.get(w, 4)) != F.lower(F.get(w, 5)), F.concat(F.get(w, 4), F.lit(" "), F.get(w, 5)))
    return table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.explode(F.array(upper(F.get(w, 2)), two)).alias("term"))


def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the terms stand in all documents; of places of one term that overlap, the first."""
    found = terms_.term_spans(table(spark, sf_dir, "documents"), terms(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


QUERIES = {f.__name__: f for f in (token_places, names_twice, term_matches)}


def matches_sql(source: str, text: str, pattern: str, keep: str) -> str:
    """``(keep, v, start)``: the matches of a pattern and where they begin."""
    return rf"""SELECT {keep}, unnest(ms) AS v, unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(bs[1:k], lambda b: length(b))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda m: length(m))), 0)))::BIGINT AS start
FROM (SELECT {keep}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS bs FROM {source})"""


NAME_COLUMNS = "['PER', 'LOC', 'ORG', 'MISC'][length(v) % 4 + 1] AS label, ((length(v) * 7 + unicode(v) * 13) % 100)::DOUBLE / 100 AS score"
SQL = {
    "token_places": rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS chunk, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
m AS ({matches_sql("l", "chunk", r"[^\x20\x09-\x0D]+", "doc_id, line")})
SELECT doc_id, line, start, start + length(v) AS "end", lower(v) AS word FROM m""",
    "names_twice": rf"""
WITH w AS (SELECT doc_id, {NAME_COLUMNS}, v, start FROM ({matches_sql("documents", "text", NAME, "doc_id")})),
l AS (SELECT doc_id, line, (SELECT coalesce(sum(length(x) + 1), 0) FROM (SELECT unnest(ls[1:k]) AS x))::BIGINT AS shift FROM (SELECT doc_id, ls, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL))),
a AS (SELECT doc_id, {NAME_COLUMNS}, v, start + shift AS start FROM ({matches_sql("l", "line", NAME, "doc_id, shift")})),
u AS (SELECT * FROM w WHERE label <> 'MISC' UNION ALL SELECT * FROM a WHERE label = 'PER' AND score >= 0.85 OR label = 'LOC' AND score >= 0.7)
SELECT doc_id, label, start + p AS start, start + p + length(x) AS "end", score FROM (
  SELECT *, 0 AS p, split_part(v, chr(10), 1) AS x FROM u UNION ALL SELECT *, strpos(v, chr(10)), split_part(v, chr(10), 2) FROM u WHERE contains(v, chr(10)))""",
    "term_matches": rf"""
WITH b AS (SELECT string_split_regex(text, '{BLANKS}') AS w FROM documents WHERE doc_id % 50 = 0),
t AS MATERIALIZED (SELECT DISTINCT lower(term) AS term, len(regexp_extract_all(lower(term), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]')) AS n FROM (SELECT upper(w[3]) AS term FROM b UNION ALL SELECT w[5] || ' ' || w[6] FROM b WHERE lower(w[5]) <> lower(w[6])) WHERE trim(term) <> ''),
d AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]') AS a FROM documents),
e AS MATERIALIZED (SELECT doc_id, i, v, regexp_matches(v, '^[\p{{L}}\p{{N}}]') AS word, coalesce(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT doc_id, unnest(a) AS v, unnest(range(len(a))) AS i FROM d)),
g AS (SELECT doc_id, i, n, lag(word) OVER o AS before, start, string_agg(lower(v), '') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS run, lead(word, n) OVER o AS after
  FROM e, (SELECT DISTINCT n FROM t) WINDOW o AS (PARTITION BY doc_id, n ORDER BY i)),
m AS MATERIALIZED (SELECT doc_id, term, start, length(run) AS len FROM g JOIN t ON t.term = g.run AND t.n = g.n WHERE before IS DISTINCT FROM true AND after IS DISTINCT FROM true),
k AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, term ORDER BY start) AS island FROM (SELECT *, CASE WHEN start < lag(start) OVER (PARTITION BY doc_id, term ORDER BY start) + len THEN 0 ELSE 1 END AS apart FROM m)),
f AS (SELECT doc_id, len, list_reduce(list_transform(list(start ORDER BY start), lambda s: [s]), lambda a, b: CASE WHEN b[1] >= a[-1] + len THEN list_concat(a, b) ELSE a END) AS starts FROM k GROUP BY doc_id, term, len, island)
SELECT doc_id, start, start + len AS "end" FROM (SELECT doc_id, len, unnest(starts) AS start FROM f)""",
}
