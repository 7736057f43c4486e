"""Spans found in text that was read from pictures, their boxes, and the lines they lie on.

A picture's text is one row; words, lines and boxes are rows with the picture's key. Boxes
are columns ``x, y, w, h`` (y grows downwards).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import WB
from ..functions.spans import SMALL, blocks, bound, part, span

#: Room around a box, in its heights; text height where a picture has no lines.
ROOM, HEIGHT = 0.18, 30


#: The bands of a picture, in shares of its height and width, where an app shows a chat's
#: name; how much taller than wide a phone's picture is; lines of the head that are no names.
HEAD_TOP, HEAD_END, HEAD_SIDE, TALL = 0.045, 0.095, 0.15, 1.4
HEAD_INFO = [
    rf"{WB}(?:members?|online|last seen|typing|subscribers?|participants?|active|recently){WB}",
    rf"{WB}(?:miembros?|en línea|escribiendo|últ\. vez|participantes){WB}",
    rf"{WB}(?:membres?|en ligne|écrit|vu(?:e)? (?:à|hier|il y a)|participants){WB}",
    rf"{WB}(?:Mitglieder|online|schreibt|zuletzt|Teilnehmer){WB}",
    rf"{WB}(?:leden|lid|typt|laatst gezien|deelnemers){WB}",
    "成员|成員|在线|在線|正在输入|最后上线|メンバー|オンライン|入力中|最終ログイン|สมาชิก|ออนไลน์|กำลังพิมพ์|ใช้งานล่าสุด",
]
#: Scripts without upper and lower case.
CASELESS = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsHangul}\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}]"


def below_status(words: DataFrame, width: Column, height: Column) -> DataFrame:
    """The words below a phone's status bar; pictures of other shapes have none."""
    top = F.when(height > width * TALL, height * HEAD_TOP).otherwise(0.0)
    return words.where(F.col("y") + F.col("h") / 2 > top)


def head_names(lines: DataFrame, width: Column, height: Column, text: str = "text") -> DataFrame:
    """The ``lines`` (``x, y, w, h`` and their text) that name a chat in an app's head: near the top, between
    the button and the picture at its ends, and no remark such as how many members there are."""
    middle = F.col("y") + F.col("h") / 2
    placed = middle.between(height * HEAD_TOP, height * HEAD_END) & (F.col("x") >= width * HEAD_SIDE) & (F.col("x") + F.col("w") <= width * (1 - HEAD_SIDE))
    said = F.col(text)
    return lines.where(placed & ~said.rlike("(?iu)" + "|".join(HEAD_INFO)) & (said.rlike(r"\p{L}{2}") | said.rlike(CASELESS)))


def hidden_counts(boxes: DataFrame, by: list[str], on: str = "on", tag: str = "tag", text: str = "text") -> DataFrame:
    """``(by, hidden, names, faces, more)``: how many boxes of a picture are hidden, how many different names
    and how many faces among them, and whether there are others."""
    shown = F.col(on)
    count = lambda c: F.count(F.when(shown & c, 1))
    name, face = F.col(tag) == "NAME", F.col(tag) == "FACE"
    return boxes.groupBy(*by).agg(count(F.lit(True)).alias("hidden"), F.count_distinct(F.when(shown & name, F.lower(text))).alias("names"), count(face).alias("faces"), (count(~F.coalesce(name | face, F.lit(False))) > 0).alias("more"))


def one_line(text: Column) -> Column:
    """The text with spaces for line breaks, at the same places, so that rules read on over
    lines. Null stays null."""
    return F.translate(text, "\n", " ")


def mended_emails(text: Column, spans: Column) -> Column:
    """Spans right behind an at sign, grown to the left up to white space, as EMAIL: a misread
    letter before the at sign stops the email rule, and only the domain is found. The others
    stay as they are; null text or spans: null."""

    def mend(s: Column) -> Column:
        left = F.substring(text, F.lit(1), F.greatest(s["start"] - 1, F.lit(0)))
        grown = span(F.lit("EMAIL"), F.length(F.regexp_replace(left, r"(?U)(?<!\S)\S+\z", "")), s["end"])
        behind = (s["start"] > 0) & (F.substring(text, s["start"], F.lit(1)) == "@")
        return F.when(behind, grown).otherwise(span(s["tag"], s["start"], s["end"]))

    return F.transform(spans, mend)


def readable_names(text: Column, spans: Column) -> Column:
    """The spans without names that are noise: those that do not begin with a letter, or have
    fewer than two, unless one is Chinese or Korean."""

    def letters(value: Column) -> Column:
        return value.rlike(r"^\p{L}\P{L}*\p{L}") | (value.rlike(r"^\p{L}") & value.rlike(r"[\p{IsHan}\p{IsHangul}]"))

    def fine(blocks: Column) -> Column:
        return F.filter(spans, lambda s: (s["tag"] != "NAME") | bound(part(blocks, s["start"], s["end"], SMALL), letters))

    return bound(blocks(text, SMALL), fine)


def with_own_boxes(boxes: DataFrame, rules: DataFrame, by: list[str], order: str = "n") -> DataFrame:
    """``boxes (by, start, end, i, x, y, w, h)``, in which a span whose place equals that of a rule
    with a box of its own (``rules (by, start, end, order, x, y, w, h)``) has that box alone; of
    several such rules, the first. Rules of null boxes, and null keys, match nothing."""
    at = [*by, "start", "end"]
    sides = ["x", "y", "w", "h"]
    own = rules.dropna(subset=[*at, *sides]).groupBy(*at).agg(F.min_by(F.struct(*sides), order).alias("own"))
    first = boxes.select(*at).distinct().join(own, at).select(*at, F.lit(0).alias("i"), *[F.col(f"own.{c}").alias(c) for c in sides])
    return boxes.select(*at, "i", *sides).join(own, at, "left_anti").unionByName(first)


def roomy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """The sides of a box with room around it."""
    pad = h * ROOM
    return [(x - pad).alias("x"), (y - pad).alias("y"), (w + 2 * pad).alias("w"), (h + 2 * pad).alias("h")]


def line_spans(parts: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """``(by, line, start, end)``: the place of each line, of its words' places."""
    return parts.groupBy(*by, line).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def text_height(lines: DataFrame, by: list[str], height: str = "h") -> DataFrame:
    """``(by, height)``: the upper median of the heights of a picture's lines, ``HEIGHT`` where it
    is 0. Heights are counted first, so that lines of one height are one row."""
    of = F.array_sort(F.collect_list(F.struct(F.col(height).alias("h"), "n")))
    counted = lines.where(F.col(height).isNotNull()).groupBy(*by, height).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(of.alias("hs"), F.floor(F.sum("n") / 2).alias("half"))
    # The first height up to which more than half of all lines (rounded down) are counted.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(lines.schema[height].dataType).alias("h"))
    step = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.when(acc["n"] > F.col("half"), acc["h"]).otherwise(x["h"]).alias("h"))
    found = F.aggregate("hs", start, step)["h"]
    return counted.select(*by, F.when(found == 0, F.lit(HEIGHT)).otherwise(found).alias("height"))
