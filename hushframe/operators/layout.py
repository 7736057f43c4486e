"""Page layout: placed text items to page text, and spans of it back to boxes.

Items are rows: a page key, a position ``n`` in reading order, ``str``, the left end ``x`` and
base line ``y``, ``width`` and font ``size``; lengths are in points, y grows upwards. Where a page's
items are one array already, ``pieces``, ``arranged`` and ``page_boxes`` do the same within the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.spans import bound, fold
from .intervals import overlapping

#: In font sizes; fixed values. A base line further off starts a line; a wider gap is a space.
LINE_STEP, WORD_GAP = 0.5, 0.15
#: Room around a box, in font sizes, at its ends, below and above the base line; fixed values.
PAD, BELOW, ABOVE = 0.2, 0.28, 0.95
#: How far edges may differ on one line, and boxes lie apart, to be joined: in box heights; fixed values.
EDGE, REACH = 0.3, 0.5


def page_parts(items: DataFrame, by: list[str], order: str = "n", eol: str | None = None) -> DataFrame:
    """The items with text, and ``piece`` (their share of the page's text, with the space or
    line break around them), ``start`` and ``end`` (their place in it).

    ``eol`` names a boolean column of items that end a line. Items without text (null or
    empty) only count for that. All windows share the page key, so there is one shuffle."""
    page = Window.partitionBy(*by).orderBy(order)
    has = F.coalesce(F.length("str") > 0, F.lit(False))
    ends = F.coalesce(F.col(eol), F.lit(False)) if eol else F.lit(False)
    if eol is None:
        rows = items.where(has).withColumn("__after", F.lit(""))
    else:
        rows = ended(items, by, page, has, ends)
    open_ended = (F.lag("__after").over(page) == "") & ~F.lag("str").over(page).rlike(r"(?U)\s$") & ~F.col("str").rlike(r"(?U)^\s")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(page)
    apart = F.when(F.abs(F.col("y") - F.lag("y").over(page)) >= LINE_STEP * F.col("size"), "\n").when(gap > WORD_GAP * F.col("size"), " ").otherwise("")
    rows = rows.withColumn("__before", F.when(open_ended, apart).otherwise("")).withColumn("piece", F.concat("__before", "str", "__after"))
    upto = F.coalesce(F.sum(F.length("piece")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", upto + F.length("__before")).withColumn("end", F.col("start") + F.length("str"))
    return rows.drop("__after", "__before")


def ended(items: DataFrame, by: list[str], page: WindowSpec, has: Column, ends: Column) -> DataFrame:
    """The items with text, and ``__after``: a line break where an item, or an empty one behind it, ends a line."""
    rows = items.withColumn("__has", has).withColumn("__at", F.sum(has.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__empty_eol", F.max(F.when(~F.col("__has"), ends)).over(Window.partitionBy(*by, "__at"))).where("__has")
    closes = ends | (F.coalesce(F.col("__empty_eol"), F.lit(False)) & ~F.col("str").endswith("\n"))
    return rows.withColumn("__after", F.when(closes, "\n").otherwise("")).drop("__has", "__at", "__empty_eol")


def pieces(items: Column) -> Column:
    """The shares of a page's text of its ``items``: an array of structs in reading order, all with text."""

    def one(s: Column, i: Column) -> Column:
        before = F.get(items, i - 1)
        apart = F.when(F.abs(s["y"] - before["y"]) >= LINE_STEP * s["size"], "\n").when(s["x"] - (before["x"] + before["width"]) > WORD_GAP * s["size"], " ").otherwise("")
        open_ended = (i > 0) & ~before["str"].rlike(r"(?U)\s$") & ~s["str"].rlike(r"(?U)^\s")
        return F.concat(F.when(open_ended, apart).otherwise(""), s["str"])

    return F.transform(items, one)


def arranged(items: Column) -> Column:
    """``array<struct<item, start, end>>``: the items with their place in the page's text, as ``page_parts``."""

    def step(at: Column, n: Column) -> tuple[Column, Column]:
        return at + n, F.array(at + n)

    ends = fold(F.transform(pieces(items), lambda p: F.length(p)), F.lit(0), "array<int>", step)
    return F.zip_with(items, ends, lambda s, e: F.struct(s.alias("item"), (e - F.length(s["str"])).alias("start"), e.alias("end")))


def page_boxes(pages: DataFrame, by: list[str], found: Callable[[Column], Column], fonts: DataFrame | None = None) -> DataFrame:
    """``span_rects`` of the spans that ``found`` tells of a page's text, for pages whose items are the
    array ``items``: no row leaves its task. Items are given places only on pages with spans."""
    texts = pages.select(*by, "items", F.array_join(pieces(F.col("items")), "").alias("__text"))
    some = texts.select(*by, "items", F.explode(F.filter(F.array(found(F.col("__text"))), lambda spans: F.size(spans) > 0)).alias("__spans"))

    def met(parts: Column) -> Column:
        touched = lambda s: F.filter(parts, lambda p: (p["start"] < s["end"]) & (p["end"] > s["start"]))
        return F.flatten(F.transform("__spans", lambda s: F.transform(touched(s), lambda p: F.struct(s["start"].alias("__s"), s["end"].alias("__e"), p["start"].alias("__ps"), p["end"].alias("__pe"), p["item"].alias("item")))))

    hit = some.select(*by, F.explode(bound(arranged(F.col("items")), met)).alias("__h")).select(*by, "__h.__s", "__h.__e", "__h.__ps", "__h.__pe", "__h.item.*")
    return boxed(hit, by, [], fonts)


def page_text(parts: DataFrame, by: list[str], order: str = "n") -> DataFrame:
    """``text`` of each page (one page is one row)."""
    pieces = F.array_sort(F.collect_list(F.struct(order, "piece")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))


def measured(text: Column, widths: Column) -> Column:
    """The width of a text by a font's ``widths`` (a map from character; others count as the mean of
    those it has, or as one), without kerning."""
    usual = F.coalesce(F.aggregate(F.map_values(widths), F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(widths), F.lit(0)), F.lit(1.0))
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(widths[c], usual)), F.lit(0.0), lambda a, v: a + v)


def span_rects(spans: DataFrame, parts: DataFrame, by: list[str], keep: list[str], fonts: DataFrame | None = None) -> DataFrame:
    """A box per span and item that it touches: ``x0, y0, x1, y1``. ``spans`` has the page key,
    ``start``, ``end`` and the columns ``keep``.

    Characters count as equally wide within an item, or as wide as ``fonts`` (``font``, ``widths``: a map
    from character) tells of the item's ``font``. Items that lie at an angle have ``a, b, c, d``, the first
    four numbers of their transform: the direction of the line and of what is up, of any length
    (``size`` is the latter's); the box is the one around the turned one. Spans meet items by bins of places, so that no task sees
    all pairs of a page."""
    turned = all(c in parts.columns for c in "abcd")
    p = parts.select(*by, "n", F.col("start").alias("__ps"), F.col("end").alias("__pe"), "x", "y", "width", "size", *(["str", "font"] if fonts is not None else []), *("abcd" if turned else ""))
    hit = overlapping(spans.select(*by, F.col("start").alias("__s"), F.col("end").alias("__e"), *keep), p, by, ("__s", "__e"), ("__ps", "__pe"))
    return boxed(hit, by, keep, fonts)


def boxed(hit: DataFrame, by: list[str], keep: list[str], fonts: DataFrame | None) -> DataFrame:
    """The boxes of items and the spans (``__s``, ``__e``) that they meet at their places (``__ps``, ``__pe``)."""
    turned = all(c in hit.columns for c in "abcd")
    first, last = F.greatest("__s", "__ps") - F.col("__ps"), F.least("__e", "__pe") - F.col("__ps")
    if fonts is None:
        each = F.col("width") / (F.col("__pe") - F.col("__ps"))
        from_, to = each * first, each * last
    else:
        hit = hit.join(fonts.select("font", F.col("widths").alias("__widths")), "font", "left")
        wide = lambda t: measured(t, F.coalesce("__widths", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
        whole = F.coalesce(F.nullif(wide(F.col("str")), F.lit(0.0)), F.lit(1.0))
        from_, to = (wide(F.substring("str", F.lit(1), k)) / whole * F.col("width") for k in (first, last))
    left, right, low, high = from_ - PAD * F.col("size"), to + PAD * F.col("size"), -BELOW * F.col("size"), ABOVE * F.col("size")
    if not turned:
        box = [F.col("x") + left, F.col("y") + low, F.col("x") + right, F.col("y") + high]
    else:
        length = F.coalesce(F.nullif(F.hypot("a", "b"), F.lit(0.0)), F.lit(1.0))
        at = lambda o, along, up, u, v: F.col(o) + F.col(along) / length * u + F.col(up) / F.col("size") * v
        corners = [(u, v) for u in (left, right) for v in (low, high)]
        xs, ys = ([at(o, along, up, u, v) for u, v in corners] for o, along, up in (("x", "a", "c"), ("y", "b", "d")))
        box = [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]
    return hit.select(*by, *keep, F.col("__s").alias("start"), F.col("__e").alias("end"), "n", *[v.alias(c) for v, c in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


def merged_rects(rects: DataFrame, by: list[str]) -> DataFrame:
    """Boxes of a group (a span of a page) that touch on one line, joined: a fold over the
    group's boxes by ``y0, x0``, as each one is compared with what the last has grown to."""
    box = "struct<y0:double,x0:double,x1:double,y1:double>"
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1")))

    def step(done: Column, r: Column) -> Column:
        last, h = F.element_at(done, -1), r["y1"] - r["y0"]
        level = (F.abs(last["y0"] - r["y0"]) < EDGE * h) & (F.abs(last["y1"] - r["y1"]) < EDGE * h)
        near = (r["x0"] <= last["x1"] + REACH * h) & (r["x1"] >= last["x0"])
        grown = F.struct(F.least(last["y0"], r["y0"]).alias("y0"), F.least(last["x0"], r["x0"]).alias("x0"), F.greatest(last["x1"], r["x1"]).alias("x1"), F.greatest(last["y1"], r["y1"]).alias("y1"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        return F.when((F.size(done) > 0) & level & near, joined).otherwise(F.concat(done, F.array(r)))

    folded = F.aggregate("__rects", F.array().cast(f"array<{box}>"), step)
    grouped = rects.groupBy(*by).agg(ordered.cast(f"array<{box}>").alias("__rects"))
    return grouped.select(*by, F.explode(folded).alias("r")).select(*by, "r.x0", "r.y0", "r.x1", "r.y1")


def keyed_bars(rects: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``i``, a bar's place among those of its span, and ``key``: page, start, end and ``i``.
    ``rects`` has the columns ``by`` of a page, ``start`` and ``end``."""
    within = Window.partitionBy(*by, "start", "end").orderBy("y0", "x0", "y1", "x1")
    rows = rects.withColumn("i", F.row_number().over(within) - 1)
    return rows.withColumn("key", F.concat_ws(":", *by, "start", "end", "i"))


def switched(bars: DataFrame, off: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Adds ``on``: false for bars whose ``key`` is in ``off``. ``manual`` bars (columns of ``bars`` but
    for ``key``, null there, and their own ``on``) are added; a null ``on`` counts as off."""
    gone = off.where(F.col("key").isNotNull()).select("key").distinct().withColumn("gone", F.lit(True))
    rows = bars.join(gone, "key", "left").withColumn("on", F.col("gone").isNull()).drop("gone")
    return rows if manual is None else rows.unionByName(manual.withColumn("on", F.coalesce("on", F.lit(False))), allowMissingColumns=True)


def status(pages: DataFrame, bars: DataFrame, doc: str) -> DataFrame:
    """``(doc, pages, bars, on, scan)`` of ``pages (doc, text)`` and ``bars (doc, on)``; ``scan`` tells that
    no page has text. A document without bars has 0 of them."""
    written = F.count_if(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"))
    page = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), (written == 0).alias("scan"))
    bar = bars.groupBy(doc).agg(F.count(F.lit(1)).alias("bars"), F.count_if("on").alias("on"))
    return page.join(bar, doc, "left").select(doc, "pages", F.coalesce("bars", F.lit(0)).alias("bars"), F.coalesce("on", F.lit(0)).alias("on"), "scan")
