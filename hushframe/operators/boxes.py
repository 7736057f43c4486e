"""Boxes: areas, padding, tiles, and which of several boxes of a picture to keep.

A box is four columns ``x, y, w, h`` (y grows downwards), or a struct of them. Everything is
native; rows of a picture meet by its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Room around a face at its sides, top and bottom, in its own sizes.
SIDES, TOP, BOTTOM = 0.18, 0.35, 0.12
#: A small face's most share of the width; more room around a larger one.
SMALL, FACE_ROOM = 0.08, 0.05
#: Side of a cell of the grid by which centers meet areas.
CELL = 128
#: Side of a tile, step from tile to tile, longest side that needs none.
TILE, STEP, WHOLE = 960, 0.75, 1.3
#: Share of a word on a shape from which it counts, letters of a short word.
ON_SHAPE, SHORT = 0.15, 3


def box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def shared(a: Column, b: Column) -> Column:
    """The area that two boxes share; 0 if they only touch."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    """The smallest box around both."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def scaled(b: Column, by: Column) -> Column:
    return box(b["x"] * by, b["y"] * by, b["w"] * by, b["h"] * by)


def holds(b: Column, inner: Column) -> Column:
    """Whether the center of ``inner`` lies inside ``b``."""
    x, y = inner["x"] + inner["w"] / 2, inner["y"] + inner["h"] / 2
    return (x > b["x"]) & (x < b["x"] + b["w"]) & (y > b["y"]) & (y < b["y"] + b["h"])


def clamped(v: Column) -> Column:
    """A value in 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def padded(b: Column, width: Column, height: Column, extra: float = 0.0) -> Column:
    """A face's box with room for hair, ears and chin, inside the picture; ``extra`` on all sides."""
    x = F.greatest(F.lit(0.0), b["x"] - b["w"] * (SIDES + extra))
    y = F.greatest(F.lit(0.0), b["y"] - b["h"] * (TOP + extra))
    right = F.least(width, b["x"] + b["w"] * (1 + SIDES + extra))
    bottom = F.least(height, b["y"] + b["h"] * (1 + BOTTOM + extra))
    return box(x, y, right - x, bottom - y)


def face_cover(b: Column, width: Column, height: Column) -> Column:
    """What to cover of a face: of a small one, likely a profile picture, the whole circle around it; of
    another its padded box."""
    side = b["w"] * 2
    circle = box(F.greatest(F.lit(0.0), b["x"] + b["w"] / 2 - side / 2), F.greatest(F.lit(0.0), b["y"] + b["h"] / 2 - side / 2), side, side)
    return F.when(b["w"] < width * SMALL, circle).otherwise(padded(b, width, height, FACE_ROOM))


def tiles(width: Column, height: Column, tile: int = TILE) -> Column:
    """``array<struct<x, y, w, h>>``: the whole picture, and of a large one overlapping tiles."""
    step = round(tile * STEP)

    def positions(length: Column) -> Column:
        # Steps that end before the picture does, and a last one at its end.
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - tile) / step).cast("int") - 1))
        return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.concat(F.transform(steps, lambda k: k * step), F.array(length - tile)))

    one = lambda y: F.transform(positions(width), lambda x: box(x, y, F.least(F.lit(tile), width - x), F.least(F.lit(tile), height - y)))
    whole = F.array(box(F.lit(0), F.lit(0), width, height))
    return F.when(F.greatest(width, height) <= tile * WHOLE, whole).otherwise(F.concat(whole, F.flatten(F.transform(positions(height), one))))


def overlapping(a: Column, b: Column, most: float = 0.3) -> Column:
    """Shapes: the shared part of the smaller one."""
    return shared(a, b) / F.least(area(a), area(b)) > most


def same_face(a: Column, b: Column, most: float = 0.3, inside: float = 0.5) -> Column:
    """Faces: shared part of both, shared part of the smaller one, or a center inside the other."""
    common = shared(a, b)
    alike = (common / (area(a) + area(b) - common) > most) | (common / F.least(area(a), area(b)) > inside)
    return (common > 0) & (alike | holds(a, b) | holds(b, a))


def strongest(boxes: DataFrame, by: list[str], order: str = "n", same: Callable[[Column, Column], Column] = overlapping) -> DataFrame:
    """``(by, order, score, x, y, w, h)``: from the highest score on (ties: by ``order``), each box
    that is not the ``same`` as one kept before it. A picture's boxes are folded in one row."""
    one = F.struct((-F.col("score")).alias("k"), F.col(order).alias("n"), "x", "y", "w", "h")
    rows = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    kind = rows.schema["boxes"].dataType.simpleString()
    keep = lambda done, b: F.when(F.exists(done, lambda k: same(b, k)), done).otherwise(F.concat(done, F.array(b)))
    kept = F.aggregate("boxes", F.array().cast(kind), keep)
    return rows.select(*by, F.explode(kept).alias("b")).select(*by, F.col("b.n").alias(order), (-F.col("b.k")).alias("score"), "b.x", "b.y", "b.w", "b.h")


def not_on_text(shapes: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """The shapes that are not letters: no word of the picture lies on one but mostly outside
    it, and no long word inside it. ``words`` has ``str``."""
    s, w = box(*[F.col(f"s.{c}") for c in "xywh"]), box(*[F.col(f"w.{c}") for c in "xywh"])
    long = F.length(F.regexp_replace(F.col("w.str"), r"[^\p{L}\p{N}]", "")) > SHORT
    on = (shared(w, s) >= area(w) * ON_SHAPE) & (~holds(s, w) | long)
    same = [F.col(f"s.{c}") == F.col(f"w.{c}") for c in by]
    for c in same:
        on = on & c
    return shapes.alias("s").join(words.alias("w"), on, "left_anti")


def not_inside(found: DataFrame, areas: DataFrame, by: list[str], cell: int = CELL) -> DataFrame:
    """The boxes of a picture whose center lies inside none of its ``areas`` (touching the rim is outside).

    Areas are dealt to the cells of a grid that they reach into, and a center lies in one cell, so that they meet by
    equality and a crowded picture is many keys. Null keys or sides are inside nothing."""
    cells = lambda a, b: F.sequence(F.floor(a / cell).cast("long"), F.greatest(F.floor(a / cell), F.floor(b / cell)).cast("long"))
    a = areas.dropna(subset=[*by, *"xywh"]).select(*by, F.struct(*"xywh").alias("__a"), F.explode(cells(F.col("x"), F.col("x") + F.col("w"))).alias("__cx"), "y", "h")
    a = a.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__a", "__cx", F.explode(cells(F.col("y"), F.col("y") + F.col("h"))).alias("__cy"))
    x, y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    own = found.withColumns({"__ox": F.floor(x / cell).cast("long"), "__oy": F.floor(y / cell).cast("long")})
    on = (F.col("__ox") == F.col("__cx")) & (F.col("__oy") == F.col("__cy")) & holds(F.col("__a"), box(*[own[c] for c in "xywh"]))
    for i, c in enumerate(by):
        on = on & (own[c] == a[f"__by{i}"])
    return own.join(a, on, "left_anti").drop("__ox", "__oy")
