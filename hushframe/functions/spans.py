"""Spans in text, as columns.

A span is ``struct<tag, start, end>``: half-open, in code points. All functions build native
Column expressions; a row's spans never leave the row, so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<tag:string,start:int,end:int>"
SPANS = f"array<{SPAN}>"
#: White space and marks that are trimmed off spans: fixed values.
LEFT_TRIM = r"^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
RIGHT_TRIM = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}.,;:!?)]+$"


def none() -> Column:
    return F.array().cast(SPANS)


def span(tag, start, end) -> Column:
    return F.struct(tag.alias("tag"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def piece(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


#: Code points of a block of text, and of one where the pieces are many and short.
BLOCK, SMALL = 2048, 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: in a lambda, it would be for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The text in blocks, for many pieces of one text: to find a piece, characters are counted from
    the beginning of what it is a piece of."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def part(blocks: Column, start: Column, end: Column, size: int = BLOCK) -> Column:
    """What lies between two places of a text in ``blocks`` of a size (a power of two)."""
    first = F.greatest(F.lit(0), F.shiftright(start, size.bit_length() - 1))
    n = F.greatest(F.lit(0), F.shiftright(end, size.bit_length() - 1) - first + 1)
    return F.substring(F.array_join(F.slice(blocks, first + 1, n), ""), start - first * size + 1, end - start)


#: Elements of an array that are folded before what they give is put to the rest.
RUN = 256


def fold(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """``aggregate`` for results that are arrays (of type ``kind``): ``step`` tells the next state and
    what to append, ``last`` what to append at the end.

    Each append copies an array, so elements are folded in runs, each with an array of its own."""
    none = F.array().cast(kind)
    acc = lambda s, out: F.struct(s.alias("s"), out.alias("out"))

    def one(a: Column, x: Column) -> Column:
        s, more = step(a["s"], x)
        return acc(s, F.concat(a["out"], more))

    def run(a: Column, xs: Column) -> Column:
        return bound(F.aggregate(xs, acc(a["s"], none), one), lambda got: acc(got["s"], F.concat(a["out"], got["out"])))

    def end(a: Column) -> Column:
        return F.concat(a["out"], last(a["s"])) if last else a["out"]

    runs = bound(items, lambda items: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(items), RUN.bit_length() - 1)), lambda k: F.slice(items, k * RUN + 1, RUN)))
    return F.aggregate(runs, acc(state, none), run, end)


MATCHES = "struct<rank:int,between:array<string>,whole:array<string>,value:array<string>>"


def matches(text: Column, pattern: str, group: int = 0, rank: int = 0, hint: Column | None = None) -> Column:
    """What a pattern matches: what lies between the matches, the matches, and the values of
    ``group``; null where there are none. ``hint``, a cheap condition that every text with a
    match fulfils, saves other texts the pattern."""
    p = F.lit(pattern)

    def found(whole: Column) -> Column:
        value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
        return F.when(F.size(whole) > 0, F.struct(F.lit(rank).alias("rank"), F.split(text, pattern, -1).alias("between"), whole.alias("whole"), value.alias("value")).cast(MATCHES))

    # The text is gone through once to see whether there are matches, and what they are.
    got = bound(F.regexp_extract_all(text, p, F.lit(0)), found)
    return got if hint is None else F.when(hint, got)


def placed(found: Column) -> Column:
    """The places of matches: ``array<struct<rank, start, end, value>>``, from left to right.

    Spark tells matches, not places: the running lengths of what lies between them and of the
    matches give the places. The group must end the match."""
    ends = F.zip_with(found["between"], found["whole"], lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["b"] + x["m"]
        return end, F.array(end)

    ends = fold(F.slice(ends, F.lit(1), F.size(found["whole"])), F.lit(0), "array<int>", step)
    return F.zip_with(ends, found["value"], lambda end, v: F.struct(found["rank"].alias("rank"), (end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))


def scan(text: Column, pattern: str, tag: str, group: int = 0, test: Callable[[Column], Column] | None = None, hint: Column | None = None) -> Column:
    """Spans of a pattern's matches, left to right; null text: none. A match that fails ``test``
    is dropped but has used up its text. The pattern must not match nothing."""
    hits = F.transform(F.filter(F.array(matches(text, pattern, group, 0, hint)), lambda m: m.isNotNull()), placed)
    hits = F.flatten(hits)
    if test:
        hits = F.filter(hits, lambda h: test(h["value"]))
    return F.transform(hits, lambda h: span(F.lit(tag), h["start"], h["end"]))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def first_wins(spans: Column) -> Column:
    """Takes spans in order, each unless it overlaps one that was taken."""
    return F.aggregate(spans, none(), lambda acc, x: F.when(F.exists(acc, lambda a: overlaps(a, x)), acc).otherwise(F.concat(acc, F.array(x))))


def first_rule_wins(rules: Column) -> Column:
    """``array<array<span>>``, one array of disjoint spans from left to right per rule, in order of
    rules: takes each span unless it overlaps one of a rule before. One sorted sweep per rule."""
    def add(taken: Column, more: Column) -> Column:
        return F.when(F.size(taken) == 0, more).otherwise(F.concat(taken, clear_of(more, taken)))

    return F.aggregate(rules, none(), add)


def clear_of(spans: Column, others: Column) -> Column:
    """Of disjoint ``spans`` those that overlap none of ``others``, from left to right. One sorted sweep,
    which holds a span back until the next of the others is seen to begin after it."""
    mark = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["tag"].alias("tag")))
    start = F.struct(F.lit(0).alias("till"), F.lit(None).cast(SPAN).alias("held"))
    some = lambda held: F.filter(F.array(held), lambda s: s.isNotNull())

    def step(acc: Column, e: Column) -> tuple[Column, Column]:
        hit = (e["own"] == 0) & (e["start"] < acc["held"]["end"])
        held = F.when((e["own"] == 1) & (e["start"] >= acc["till"]), span(e["tag"], e["start"], e["end"]))
        till = F.when(e["own"] == 0, F.greatest(acc["till"], e["end"])).otherwise(acc["till"])
        return F.struct(till.alias("till"), held.alias("held")), F.when(hit, none()).otherwise(some(acc["held"]))

    return fold(F.array_sort(F.concat(mark(others, 0), mark(spans, 1))), start, SPANS, step, lambda acc: some(acc["held"]))


def ordered(spans: Column) -> Column:
    """By start, then longest first."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["tag"].alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: span(k["c"], k["a"], -k["b"]))


def coalesce(spans: Column) -> Column:
    """Overlapping spans become one, tagged by a span longer than what it joins; touching
    ones stay apart. Sorted by start."""

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        apart = held.isNull() | (x["start"] >= held["end"])
        longer = (x["end"] - x["start"]) > (held["end"] - held["start"])
        joined = span(F.when(longer, x["tag"]).otherwise(held["tag"]), held["start"], F.greatest(held["end"], x["end"]))
        return F.when(apart, x).otherwise(joined), F.when(apart & held.isNotNull(), F.array(held)).otherwise(none())

    return fold(ordered(spans), F.lit(None).cast(SPAN), SPANS, step, lambda held: F.when(held.isNull(), none()).otherwise(F.array(held)))


def trimmed(text: Column, spans: Column) -> Column:
    """Spans without white space at the start, or white space and marks at the end; spans of
    nothing else go."""

    def cut(blocks: Column) -> Column:
        found = F.transform(spans, lambda s: F.struct(s["tag"].alias("tag"), s["start"].alias("start"), part(blocks, s["start"], s["end"]).alias("value")))
        found = F.transform(found, lambda s: F.struct(s["tag"].alias("tag"), (s["start"] + F.length(s["value"])).alias("end"), F.regexp_replace(s["value"], LEFT_TRIM, "").alias("rest")))
        found = F.transform(found, lambda s: F.struct(s["tag"].alias("tag"), (s["end"] - F.length(s["rest"])).alias("start"), F.length(F.regexp_replace(s["rest"], RIGHT_TRIM, "")).alias("n")))
        return F.transform(F.filter(found, lambda s: s["n"] > 0), lambda s: span(s["tag"], s["start"], s["start"] + s["n"]))

    return bound(blocks(text), cut)


def split_at_lines(text: Column, spans: Column) -> Column:
    """Spans cut at line ends, empty ones left out."""

    def lines(s: Column, blocks: Column) -> Column:
        start = F.struct(s["start"].alias("at"), none().alias("out"))

        def step(acc: Column, line: Column) -> Column:
            end = acc["at"] + F.length(line)
            return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(span(s["tag"], acc["at"], end))).alias("out"))

        return F.aggregate(F.split(part(blocks, s["start"], s["end"]), "\n", -1), start, step, lambda acc: acc["out"])

    cut = bound(blocks(text), lambda blocks: F.flatten(F.transform(spans, lambda s: lines(s, blocks))))
    return F.filter(cut, lambda s: s["end"] > s["start"])


def rebuilt(text: Column, subs: Column) -> Column:
    """The text with ``array<struct<start, end, sub>>`` (sorted, disjoint) put in place."""

    def join(both: Column) -> Column:
        blocks, subs = both["blocks"], both["subs"]
        end = lambda i: F.coalesce(F.get(subs, i)["end"], F.lit(0))
        parts = F.transform(subs, lambda x, i: F.concat(part(blocks, end(i - 1), x["start"]), F.coalesce(x["sub"], F.lit(""))))
        return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(subs) - 1) + 1, F.length(text)))

    return bound(F.struct(blocks(text).alias("blocks"), subs.alias("subs")), join)
