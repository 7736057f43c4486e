"""Queries over the text tables, one per rule or operator, and their SQL.

The texts are all documents and all pages. DuckDB's patterns know no look-around, but its
``\\b`` is the ASCII boundary that the rules mean, so the SQL states each rule a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.spans import coalesce, first_rule_wins, ordered, piece
from ..operators.chat import anonymize
from ..operators.redact import detect_terms, masked, redact
from ..session import table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return docs.union(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html"))


def exploded(df: DataFrame, spans: str) -> DataFrame:
    return df.select("id", "text", F.explode(spans).alias("s")).select("id", F.col("s.tag").alias("tag"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), piece(F.col("text"), F.col("s")).alias("value"))


def scan_query(rule: R.Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exploded(texts(spark, sf_dir).withColumn("s", rule.spans(F.col("text"))), "s")

    return run


TEXTS = "SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages"
LUHN = """(len(regexp_replace(value, '[^0-9]', '', 'g')) > 0 AND list_sum(list_transform(range(1, len(regexp_replace(value, '[^0-9]', '', 'g')) + 1),
  lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(value, '[^0-9]', '', 'g'))[i] AS INTEGER)
    ELSE (2 * CAST(reverse(regexp_replace(value, '[^0-9]', '', 'g'))[i] AS INTEGER)) // 10 + (2 * CAST(reverse(regexp_replace(value, '[^0-9]', '', 'g'))[i] AS INTEGER)) % 10 END)) % 10 = 0)"""
#: The rules for DuckDB: pattern, group, options, further condition.
PLAIN = {
    "key": (r"\b(?:sk|pk|rk)[-_](?:live|test)[-_][A-Za-z0-9]{8,}\b|\bsk-[A-Za-z0-9_-]{16,}|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bgithub_pat_[A-Za-z0-9_]{30,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}\b|\bAIza[0-9A-Za-z_-]{35}\b|\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", 0, "", "true"),
    "assigned": (r"\b(?:password|passwd|pwd|pass|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{4,})", 1, "i", "true"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, "", "true"),
    "url": (r"\bhttps?://[^\s<>\"')\]]+[^\s<>\"')\].,;:!?]", 0, "i", "true"),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", 0, "", "len(regexp_replace(value, '[^0-9]', '', 'g')) >= 8"),
    "card": (r"\b\d(?:[ -]?\d){12,18}\b", 0, "", LUHN),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", 0, "", "true"),
    "nino": (r"\b[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b", 0, "", "true"),
    "ip": (r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b|\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b", 0, "i", "true"),
    "date": (rf"\b\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}\b|\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\b|\b\d{{1,2}}(?:st|nd|rd|th)? (?:{R.ENGLISH_MONTHS})\.?,? \d{{4}}\b|\b(?:{R.ENGLISH_MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}\b", 0, "i", "true"),
    "postcode": (r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b", 0, "", "true"),
    "street": (rf"\b\d{{1,5}}[A-Z]?,? (?:[A-Z][a-z]+ ){{1,3}}(?:{R.STREETS})\b", 0, "", "true"),
}


def spans_sql(name: str, source: str = TEXTS) -> str:
    """SQL for a rule's spans: ``id, tag, start, end, value``."""
    pattern, group, options, test = PLAIN[name]
    rule = next(r for r in R.GENERAL if r.name == name)
    flag = f"(?{options})" if options else ""
    p = (flag + pattern).replace("'", "''")
    return f"""
SELECT id, tag, start, "end", value FROM (
  SELECT id, '{rule.tag}' AS tag, m[i] AS whole, g[i] AS value,
    CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: len(x))), 0) AS BIGINT) AS "end",
    "end" - len(g[i]) AS start
  FROM (
    SELECT id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS p
      FROM ({source}) WHERE regexp_matches(text, '{p}'))))
WHERE {test}"""


def emails_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with email addresses as labels: the scan, masked and rebuilt."""
    email = next(r for r in R.GENERAL if r.name == "email")
    return masked(texts(spark, sf_dir).withColumn("spans", email.spans(F.col("text")))).select("id", "masked")


def four_rules() -> Column:
    """First come first served over four rules that overlap."""
    by = {r.name: r for r in R.GENERAL}
    return first_rule_wins(R.detect(F.col("text"), [by[n] for n in ("assigned", "email", "card", "ip")]))


def found_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).withColumn("spans", ordered(four_rules()))


def values_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, what four rules find numbered by tag and value."""
    return masked(found_texts(spark, sf_dir), "numbered").select("id", "masked")


def values_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as blocks of their length."""
    return masked(found_texts(spark, sf_dir), "blocks").select("id", "masked")


def values_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbered, but those that begin at every third place are kept; they use up numbers."""
    kept = F.transform(F.filter("spans", lambda s: s["start"] % 3 == 0), lambda s: F.concat_ws(":", s["start"], s["end"]))
    return masked(found_texts(spark, sf_dir).withColumn("keep", kept), "numbered", kept="keep").select("id", "masked")


def first_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four rules that overlap find, first come first served."""
    return exploded(texts(spark, sf_dir).withColumn("s", four_rules()), "s")


def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the same rules joined; bounds only, as SQL tells them by islands."""
    by = {r.name: r for r in R.GENERAL}
    found = coalesce(F.flatten(R.detect(F.col("text"), [by[n] for n in ("assigned", "email", "card", "ip")])))
    return exploded(texts(spark, sf_dir).withColumn("s", found), "s").select("id", "start", "end", "value")


FOUR = " UNION ALL ".join(f"SELECT *, {k} AS rank FROM ({spans_sql(n)})" for k, n in enumerate(("assigned", "email", "card", "ip")))
FIRST_SQL = f"""
WITH RECURSIVE s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY rank, start) AS n, tag, start, "end", value FROM ({FOUR})),
t AS (
  SELECT id, n, [{{'a': start, 'b': "end", 'n': n}}] AS taken FROM s WHERE n = 1
  UNION ALL
  SELECT s.id, s.n, CASE WHEN len(list_filter(t.taken, lambda x: x.a < s."end" AND x.b > s.start)) > 0 THEN t.taken
    ELSE list_append(t.taken, {{'a': s.start, 'b': s."end", 'n': s.n}}) END
  FROM t JOIN s ON s.id = t.id AND s.n = t.n + 1
), done AS (SELECT id, arg_max(taken, n) AS taken FROM t GROUP BY id)
SELECT s.id, tag, start, "end", value FROM s JOIN done USING (id) WHERE list_contains(list_transform(taken, lambda x: x.n), s.n)
"""
COALESCED_SQL = f"""
WITH s AS (SELECT id, start, "end", max("end") OVER (PARTITION BY id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({FOUR})),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY start, "end" DESC) AS k FROM s),
b AS (SELECT id, k, min(start) AS start, max("end") AS "end" FROM g GROUP BY id, k)
SELECT b.id, start, "end", substr(text, start + 1, "end" - start) AS value FROM b JOIN ({TEXTS}) t ON b.id = t.id
"""


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"), "numbered").select("doc_id", "masked")


def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "pages").select("page_id", "html"), "blocks", text="html").select("page_id", "masked")


def redact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only words to hide always."""
    found = texts(spark, sf_dir).withColumn("spans", detect_terms(F.col("text"), ["thing", "licensed under"]))
    return exploded(found, "spans")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat exports, a line per turn, with names replaced."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), F.regexp_replace(t["text"], "\n", " ")))
    return anonymize(turns.select("conv_id", F.array_join(lines, "\n").alias("text"))).select("conv_id", "masked")


def tags_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit: hidden spans by source and language with subtotals, over three rules."""
    by = {r.name: r for r in R.GENERAL}
    docs = table(spark, sf_dir, "documents").withColumn("spans", F.flatten(R.detect(F.col("text"), [by[n] for n in ("email", "card", "ip")])))
    rows = docs.select("source", "lang", F.explode("spans").alias("s")).select("source", "lang", F.col("s.tag").alias("tag"))
    return rows.rollup("source", "lang", "tag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def with_docs(name: str) -> str:
    return spans_sql(name, "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")


TAGS_SQL = f"""
SELECT source, lang, tag, count(*) AS n, CAST(grouping(source, lang, tag) AS BIGINT) AS level
FROM ({' UNION ALL '.join(f'SELECT * FROM ({with_docs(n)})' for n in ('email', 'card', 'ip'))}) s JOIN documents d ON s.id = CAST(d.doc_id AS VARCHAR)
GROUP BY ROLLUP (source, lang, tag)
"""


def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents with the most email addresses."""
    email = next(r for r in R.GENERAL if r.name == "email")
    found = table(spark, sf_dir, "documents").select("doc_id", F.size(email.spans(F.col("text"))).cast("long").alias("n"))
    return found.where("n > 0").orderBy(F.desc("n"), "doc_id").limit(50)


QUERIES = {f"scan_{r.name}": scan_query(r) for r in [*R.GENERAL, *R.NATIONAL, R.FOREIGN_DATES, R.DOMAIN, R.HANDLE, R.SCREEN_DATE, R.MENTION]} | {f"secret_{r.name}": scan_query(r) for r in R.SECRETS}


def masked_sql(sub: str) -> str:
    """SQL for texts with ``sub`` in place of what four rules find; ``n`` is a value's number."""
    return f"""
WITH t AS ({TEXTS}), s AS (SELECT id, tag, start, "end" AS stop, value FROM ({FIRST_SQL})),
f AS (SELECT *, min(start) OVER (PARTITION BY id, tag, lower(value)) AS first, coalesce(lag(stop) OVER (PARTITION BY id ORDER BY start), 0) AS before FROM s),
n AS (SELECT *, dense_rank() OVER (PARTITION BY id, tag ORDER BY first) AS n FROM f),
m AS (SELECT id, string_agg(substr(text, before + 1, start - before) || {sub}, '' ORDER BY start) AS head, max(stop) AS last FROM n JOIN t USING (id) GROUP BY id)
SELECT t.id, coalesce(head, '') || substr(text, coalesce(last, 0) + 1) AS masked FROM t LEFT JOIN m USING (id)"""


NUMBERED = "'[' || tag || '_' || CAST(n AS VARCHAR) || ']'"
QUERIES |= {f.__name__: f for f in (emails_masked, values_numbered, values_blocked, values_kept, first_come, coalesced, redact_documents, redact_pages, redact_terms, chats, tags_by_source, top_documents)}
SQL = {f"scan_{n}": spans_sql(n) for n in PLAIN} | {
    "emails_masked": f"SELECT id, regexp_replace(text, '{PLAIN['email'][0]}', '[EMAIL]', 'g') AS masked FROM ({TEXTS})",
    "values_numbered": masked_sql(NUMBERED),
    "values_blocked": masked_sql("repeat('█', greatest(3, length(value)))"),
    "values_kept": masked_sql(f"CASE WHEN start % 3 = 0 THEN value ELSE {NUMBERED} END"),
    "first_come": FIRST_SQL,
    "coalesced": COALESCED_SQL,
    "tags_by_source": TAGS_SQL,
    "top_documents": f"SELECT CAST(id AS BIGINT) AS doc_id, count(*) AS n FROM ({with_docs('email')}) GROUP BY id ORDER BY n DESC, doc_id LIMIT 50",
}
