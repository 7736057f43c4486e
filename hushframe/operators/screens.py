"""Screen recordings as tables: what changed between two frames, what was on show and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The mean light below which a screen is dark, of every so manyth pixel; at every how manyth
#: check faces are looked for, and the seconds a face's track may go unseen then.
DARK, EVERY_PIXEL, FACE_EVERY, FACE_GAP = 110, 4, 2, 2.0
#: A clear change of gray, pixels that make a changed row, rows apart in one band.
CLEAR, PIXELS, APART = 24, 2, 3


def changed_rows(rows: DataFrame, by: str, frame: str = "n", row: str = "y", gray: str = "gray") -> DataFrame:
    """The rows of pixels (``gray``: an array) that differ clearly from the frame before. The
    first frame, and rows new to a frame, have nothing to differ from."""
    before = F.lag(gray).over(Window.partitionBy(by, row).orderBy(frame))
    clear = F.filter(F.zip_with(gray, "__before", lambda a, b: F.abs(a - b) > CLEAR), lambda c: c)
    return rows.withColumn("__before", before).where("__before IS NOT NULL").where(F.size(clear) >= PIXELS).select(by, frame, row)


def changed_bands(rows: DataFrame, by: str, height: Column, frame: str = "n", row: str = "y", gray: str = "gray") -> DataFrame:
    """``(by, frame, y0, y1)``: changed rows close together as bands, a row larger on each side."""
    w = Window.partitionBy(by, frame).orderBy(row)
    found = changed_rows(rows, by, frame, row, gray)
    new = F.coalesce(F.col(row) - F.lag(row).over(w) > APART + 1, F.lit(True)).cast("int")
    found = found.withColumn("__band", new).withColumn("__band", F.sum("__band").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = found.groupBy(by, frame, "__band").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    return ends.select(by, frame, F.greatest(F.lit(0), F.col("a") - 1).alias("y0"), F.least(height, F.col("b") + 2).alias("y1"))


def items(entries: DataFrame, by: str, time: str, tag: str = "tag", value: str = "value") -> DataFrame:
    """``(by, item, first, last, most)``: the same text of a recording as one item, when it was
    first and last on show, and how often it showed at once, at most."""
    item = F.concat(F.col(tag), F.lit(":"), F.regexp_replace(F.lower(value), r"\s+", " "))
    at_once = entries.groupBy(by, item.alias("item"), time).agg(F.count(F.lit(1)).alias("n"))
    return at_once.groupBy(by, "item").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.max("n").alias("most"))


def scrolled(frames: DataFrame, by: str, time: str, shift: str, out: str = "scroll") -> DataFrame:
    """The scroll since the start, from the scroll of each frame (null: none)."""
    return frames.withColumn(out, F.sum(F.coalesce(F.col(shift), F.lit(0))).over(Window.partitionBy(by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))


def typed_from(snapshots: DataFrame, firsts: DataFrame, by: str, n: str = "n", text: str = "text", scroll: str = "scroll") -> DataFrame:
    """``(by, item, since)``: how far back an item that first shows at frame ``n`` was being typed.

    ``firsts`` has ``(by, n, item, value)``, values of at least six characters count. The frames
    right before that show a beginning of the value (a word of two characters or more), at the
    same scroll, belong to it. Only words that are beginnings are joined, by equality: each
    value is spread into its beginnings. Without such a frame there is no row."""
    low = F.lower("value")
    starts = firsts.where(F.length("value") >= 6).select(by, F.col(n).alias("__at"), "item", F.explode(F.transform(F.sequence(F.lit(2), F.length(low) - 1), lambda k: F.substring(low, F.lit(1), k))).alias("word"))
    words = snapshots.select(by, n, scroll, F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word")).where(F.length("word") >= 2)
    there = snapshots.select(by, F.col(n).alias("__at"), F.col(scroll).alias("__scroll"))
    hits = starts.join(words, [by, "word"]).where(F.col(n) < F.col("__at")).join(there, [by, "__at"]).where(F.col(scroll) == F.col("__scroll")).select(by, "__at", "item", n).distinct()
    # Frames are numbered without gaps: the unbroken run up to the item's frame has n + rank constant.
    back = F.row_number().over(Window.partitionBy(by, "__at", "item").orderBy(F.desc(n)))
    return hits.withColumn("__k", back).where(F.col(n) + F.col("__k") == F.col("__at")).groupBy(by, "item", F.col("__at").alias("shown")).agg(F.min(n).alias("since"))


def is_dark(light: Column) -> Column:
    """Whether a region is dark on the mean, so that its light text is read once more as dark text on
    white: of an array of luma, every fourth pixel counts. A null or empty region is not dark."""
    some = F.filter(light, lambda _, i: i % EVERY_PIXEL == 0)
    return F.coalesce(F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(some), F.lit(0)) < DARK, F.lit(False))


def face_checks(checks: DataFrame, n: str = "n") -> DataFrame:
    """The checks, numbered from 1, at which faces are looked for; what is found there goes to the
    tracker with a gap of ``FACE_GAP``."""
    return checks.where((F.col(n) - 1) % FACE_EVERY == 0)
