"""What a redacted document still gives away: covered and hidden words, annotations, details
and old versions, as findings of two levels, and a report of them.

Words and pixels, annotations and details are tables, keyed by document; files are read as
binary columns. All of it is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A flat area's greatest deviation of luma, and a dark one's greatest mean.
FLAT, DARK = 6.0, 60.0
#: Items of a finding that are shown.
SHOWN = 50
#: Kind, level, title and detail of the findings, in order.
KINDS = [
    ("covered", "leak", "Text under black bars", "These words are covered on the page, but anyone can copy them from the file."),
    ("hidden", "leak", "Hidden text", "This text is in the file but cannot be seen on the page, for example white text or text under a white box."),
    ("pending", "leak", "Redactions marked but not applied", "Someone marked these areas for redaction, but the text under them is still in the file."),
    ("versions", "leak", "{n} saved versions in one file", "The file was saved over without being rebuilt, so earlier versions are still inside it."),
    ("outside", "check", "Text outside the page", "This text is in the file, outside the visible page area."),
    ("comment", "check", "Comments and notes", "Comments are saved in the file and often contain names."),
    ("field", "check", "Form fields with values", "Filled form fields are saved in the file."),
    ("attached", "check", "Attached files", "Files attached inside the PDF are shared with it."),
    ("details", "check", "Document details (metadata)", "These details are saved in the file and show in PDF apps."),
]
#: What else the finding of versions says, with details of them and without.
OLD_SHOWN, OLD_THERE = " These details from an earlier version are still readable:", " Text removed in a later version can still be read."
#: The share of a word's box that is left out at either end, above and below; pixels
#: looked at in a row.
ENDS, RIMS, ACROSS = 0.2, 0.3, 120
#: Fields of a document's details and their labels.
FIELDS = {"Title": "Title", "Author": "Author", "Subject": "Subject", "Keywords": "Keywords", "Creator": "Creator", "Producer": "Producer", "CreationDate": "Created", "ModDate": "Changed"}


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def word_looks(words: DataFrame, rows: DataFrame, pages: DataFrame, by: list[str], order: str = "n") -> DataFrame:
    """``(by, order, look)`` of the words of a page drawn as pixels: ``outside`` of it, ``covered`` (its
    middle is of one dark colour), ``hidden`` (of one other colour) or null.

    ``words``: the page ``by``, ``order`` and a box ``x, y, w, h`` in pixels; ``rows``: a page's rows of
    pixels, ``y`` and ``light``, an array of luma; ``pages``: ``width`` and ``height``. Word boxes have room at
    their ends, and a bar may stop right at the first letter, so the middle is looked at: its rows are
    met by equality, so that a page is never one row, and sums of a row's part are joined. Boxes whose
    middle is less than two pixels wide or high, or whose rows are missing, have no look."""
    x, y, right, low = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    w = words.join(pages.select(*by, F.col("width").alias("__w"), F.col("height").alias("__h")), by)
    out = (right < 0) | (low < 0) | (x > F.col("__w")) | (y > F.col("__h"))
    side = lambda at, size, share, most: (F.greatest(F.lit(0), F.floor(at + size * share)).cast("int"), F.least(most.cast("int"), F.ceil(at + size * (1 - share)).cast("int")))
    (x0, x1), (y0, y1) = side(x, F.col("w"), ENDS, F.col("__w")), side(y, F.col("h"), RIMS, F.col("__h"))
    box = w.select(*by, order, out.alias("__out"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    big = ~F.col("__out") & (F.col("x1") - F.col("x0") >= 2) & (F.col("y1") - F.col("y0") >= 2)
    step = F.greatest(F.lit(1), F.floor((F.col("x1") - F.col("x0")) / ACROSS).cast("int"))
    each = box.where(big).select(*by, order, "x0", "x1", step.alias("step"), F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    part = F.transform(F.sequence("x0", F.col("x1") - 1, "step"), lambda i: F.get("light", i))
    seen = each.join(rows.select(*by, F.col("y").cast("int").alias("y"), "light"), [*by, "y"]).withColumn("part", F.filter(part, lambda v: v.isNotNull()))
    add = lambda f: F.aggregate("part", F.lit(0.0), lambda a, v: a + f(v))
    sums = seen.select(*by, order, F.size("part").alias("__k"), add(lambda v: v).alias("__s"), add(lambda v: v * v).alias("__s2")).groupBy(*by, order).agg(*[F.sum(c).alias(c) for c in ("__k", "__s", "__s2")])
    mean = F.col("__s") / F.col("__k")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("__s2") / F.col("__k") - mean * mean))
    inside = sums.where("__k > 0").select(*by, order, F.when((sd < FLAT) & (mean < DARK), "covered").when(sd < FLAT, "hidden").alias("look"))
    return box.join(inside, [*by, order], "left").select(*by, order, F.when(F.col("__out"), "outside").otherwise(F.col("look")).alias("look"))


def light_rows(pixels: DataFrame, by: list[str], row: str = "y", column: str = "x") -> DataFrame:
    """``(by, y, light)``: single pixels ``r, g, b`` as rows of luma, from left to right."""
    line = F.array_sort(F.collect_list(F.struct(F.col(column).alias("x"), luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))))
    return pixels.groupBy(*by, F.col(row).alias("y")).agg(F.transform(line, lambda p: p["l"]).alias("light"))


def looks(pixels: DataFrame, by: list[str], light: Column) -> DataFrame:
    """``(by, look)``: what covers a word, from the pixels of its middle: ``covered`` (flat and
    dark), ``hidden`` (flat) or null. Words of fewer than four pixels have no look."""
    seen = pixels.groupBy(*by).agg(F.count(light).alias("n"), F.avg(light).alias("mean"), F.stddev_pop(light).alias("sd"))
    flat = (F.col("n") >= 4) & (F.col("sd") < FLAT)
    return seen.select(*by, F.when(flat & (F.col("mean") < DARK), "covered").when(flat, "hidden").alias("look"))


def phrases(words: DataFrame, by: list[str], order: str = "n", look: str = "look", text: str = "str") -> DataFrame:
    """``(by, look, first, text)``: words in a row with the same look as one phrase."""
    line = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(look).over(line).eqNullSafe(F.col(look)), 0).otherwise(1)
    rows = words.withColumn("run", new).withColumn("run", F.sum("run").over(line.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(look).isNotNull())
    parts = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"))))
    return rows.groupBy(*by, "run", look).agg(F.min(order).alias("first"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text")).drop("run")


def annotation_items(notes: DataFrame, by: list[str], order: str = "n") -> DataFrame:
    """``(by, order, kind, text)`` of annotations ``(subtype, contents, title, field_name,
    field_value)``: pending redactions, filled fields, comments. Links say nothing."""
    said = F.length(F.trim(F.coalesce("contents", F.lit("")))) > 0
    value = F.coalesce("field_value", F.lit(""))
    filled = (F.length(F.trim(value)) > 0) & (value != "Off")
    who = F.coalesce("title", F.lit(""))
    kind = F.when(F.col("subtype") == "Redact", "pending").when(F.col("subtype") == "Widget", F.when(filled, "field")).when(said & (F.col("subtype") != "Link"), "comment")
    text = F.when(F.col("subtype") == "Redact", F.when(F.length(F.coalesce("contents", F.lit(""))) > 0, F.col("contents")).otherwise("(no label)"))
    text = text.when(F.col("subtype") == "Widget", F.concat(F.coalesce(F.nullif("field_name", F.lit("")), F.lit("Field")), F.lit(": "), value))
    text = text.otherwise(F.when(who != "", F.concat(who, F.lit(": "), F.col("contents"))).otherwise(F.col("contents")))
    return notes.select(*by, order, kind.alias("kind"), text.alias("text")).where("kind IS NOT NULL")


def pdf_date(value: Column) -> Column:
    """A date of a document's details as year-month-day, as far as it goes; others as they are."""
    part = lambda k: F.nullif(F.regexp_extract(value, r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?", k), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("-", part(1), part(2), part(3)), F.lit("")), value)


def detail_items(info: Column) -> Column:
    """``array<string>`` of a map of details: those of the known fields that are not blank."""
    line = lambda k, label: F.when(F.length(F.trim(info[k])) > 0, F.concat(F.lit(f"{label}: "), pdf_date(info[k]) if k.endswith("Date") else info[k]))
    return F.array_compact(F.array(*[line(k, label) for k, label in FIELDS.items()]))


def latin1(content: Column) -> Column:
    """Bytes as text, a character each."""
    return F.decode(content, "ISO-8859-1")


#: A detail as a literal or hexadecimal string; a literal of any length, in one pass.
DETAIL = r"/(Title|Author|Subject|Keywords)\s*(?:\(([^\\)]*+(?:\\[^\n\r][^\\)]*+)*+)\)|<([0-9A-Fa-f\s]*+)>)"


def versions(content: Column) -> Column:
    """How often the file was saved."""
    return F.regexp_count(latin1(content), F.lit("%%EOF"))


def unhexed(value: Column) -> Column:
    """A hexadecimal string's text: UTF-16 after its mark, else a byte a letter."""
    digits = F.upper(F.regexp_replace(value, r"\s+", ""))
    even = F.substring(digits, F.lit(1), (F.length(digits) - F.length(digits) % 2).cast("int"))
    return F.when(even.startswith("FEFF"), F.decode(F.unhex(F.substring(even, F.lit(5), F.length(even))), "UTF-16BE")).otherwise(F.decode(F.unhex(even), "ISO-8859-1"))


def old_details(content: Column, current: Column) -> Column:
    """``array<string>``: details of a file saved more than once that are not ``current`` ones."""
    raw = latin1(content)
    all_of = lambda k: F.regexp_extract_all(raw, F.lit(DETAIL), F.lit(k))
    three = F.arrays_zip(all_of(1).alias("k"), all_of(2).alias("text"), all_of(3).alias("hex"))
    value = lambda x: F.when(x["hex"] != "", unhexed(x["hex"])).otherwise(F.regexp_replace(x["text"], r"\\([^\n\r])", "$1"))
    lines = F.transform(F.filter(F.transform(three, lambda x: F.struct(x["k"].alias("k"), value(x).alias("v"))), lambda x: F.length(F.trim(x["v"])) > 0), lambda x: F.concat(x["k"], F.lit(": "), x["v"]))
    return F.when(versions(content) > 1, F.array_except(lines, current)).otherwise(F.array().cast("array<string>"))


def document_items(files: DataFrame, by: list[str], info: Column, attached: Column) -> DataFrame:
    """``(by, n, kind, text)`` of files: details (from a map) and the names of files attached (an array;
    a null name is told as such). Null maps and arrays have none."""
    name = F.transform(attached, lambda f: F.when(F.length(f) > 0, f).otherwise("Attachment"))
    kinds = [("attached", name), ("details", detail_items(info))]
    line = lambda kind: lambda t, i: F.struct(i.alias("n"), F.lit(kind).alias("kind"), t.alias("text"))
    lines = F.concat(*[F.coalesce(F.transform(v, line(k)), F.array().cast("array<struct<n:int,kind:string,text:string>>")) for k, v in kinds])
    return files.select(*by, F.explode(lines).alias("i")).select(*by, "i.*")


def version_findings(files: DataFrame, by: list[str], content: Column, info: Column, shown: int = SHOWN) -> DataFrame:
    """The finding, in the columns of ``findings``, on each file that was saved more than once: how
    often, and what it still tells of earlier versions, if anything."""
    place, (_, level, title, detail) = next((i, k) for i, k in enumerate(KINDS) if k[0] == "versions")
    found = files.select(*by, versions(content).alias("__n"), F.array_distinct(old_details(content, F.coalesce(detail_items(info), F.array().cast("array<string>")))).alias("__old")).where("__n > 1")
    size = F.size("__old")
    more = F.when(size > shown, F.array(F.concat(F.lit("…and "), (size - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    count = F.concat(F.col("__n").cast("string"), F.lit(title.removeprefix("{n}")))
    said = F.concat(F.lit(detail), F.when(size > 0, OLD_SHOWN).otherwise(OLD_THERE))
    return found.select(*by, F.lit(place).alias("place"), F.lit(level).alias("level"), count.alias("title"), said.alias("detail"), size.cast("long").alias("n"), F.concat(F.slice("__old", 1, shown), more).alias("items"))


def findings(items: DataFrame, by: list[str], order: str = "n", shown: int = SHOWN) -> DataFrame:
    """``(by, place, level, title, detail, n, items)`` of ``(by, order, kind, text)``: one row per
    kind, leaks before checks, with the first ``shown`` items and a line for the others.

    Items are ranked before they meet, so a document with any number of them is one short row."""
    spark = items.sparkSession
    known = spark.createDataFrame([(k, i, *rest) for i, (k, *rest) in enumerate(KINDS)], "kind string, place int, level string, title string, detail string")
    group = Window.partitionBy(*by, "kind").orderBy(order, "text")
    first = items.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= shown)
    listed = first.groupBy(*by, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("items"))
    sizes = items.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > shown, F.array(F.concat(F.lit("…and "), (F.col("n") - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return listed.join(sizes, [*by, "kind"]).join(F.broadcast(known), "kind").select(*by, "place", "level", "title", "detail", "n", F.concat("items", more).alias("items"))


def report(found: DataFrame, by: list[str], name: Column) -> DataFrame:
    """``(by, report)``: the findings of each document as text, in order."""
    lines = F.concat(F.lit("["), F.upper("level"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("detail"), F.array_join(F.transform("items", lambda i: F.concat(F.lit("\n  - "), i)), ""))
    parts = F.array_sort(F.collect_list(F.struct("place", lines.alias("t"))))
    leaks = F.max(F.col("level") == "leak")
    rows = found.groupBy(*by).agg(parts.alias("parts"), leaks.alias("leaks"))
    head = F.concat(F.lit("Redaction check: "), name, F.when(F.col("leaks"), "").otherwise("\n\nNo leaks found."))
    return rows.select(*by, F.concat(head, F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n")).alias("report"))
