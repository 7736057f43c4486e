"""Tracks: boxes found at sampled times, joined into one track per moving object.

A detection is a row: a key (a video), a time ``t`` in seconds, ``x, y, w, h`` and ``score``.
The tracker is the one step that needs the rows in order; its tasks read a key's rows as a
sorted stream and keep only the live tracks, so a long video never has to fit into memory.
All that follows is joins, windows and aggregates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .redact import free

#: Seconds a track may go unseen, overlap and distance (in box sizes) that a
#: match needs, weight of the distance, and how many steps a movement is carried on.
MAX_GAP, LEAST_OVERLAP, MOST_DISTANCE, DISTANCE_WEIGHT, MOST_STEPS = 1.2, 0.1, 1.0, 0.5, 2.0
#: Least score of a track of one detection; longest short track (s); nearness.
LONE_SCORE, SHORT, NEAR = 0.7, 1.5, 1.2
#: Seconds before the first and after the last detection; trail of a cover.
LEAD, HOLD, TRAIL = 0.2, 0.5, 0.4
SIDES = ["x", "y", "w", "h"]


@dataclass
class Live:
    """The live tracks: their numbers and their last two detections, as rows ``(t, x, y, w, h)``; a track of
    one detection has no earlier one (nan)."""

    track: np.ndarray
    last: np.ndarray
    before: np.ndarray

    def at(self, rows: np.ndarray) -> Live:
        return Live(self.track[rows], self.last[rows], self.before[rows])

    def expected(self, t: float) -> np.ndarray:
        """Where their boxes should be at ``t`` if they move on as they did last."""
        passed = self.last[:, 0] - self.before[:, 0]
        share = np.minimum(MOST_STEPS, (t - self.last[:, 0]) / np.where(passed == 0, 1, passed))
        ahead = self.last[:, 1:] + (self.last[:, 1:] - self.before[:, 1:]) * share[:, None]
        ahead[:, 2:] = np.maximum(ahead[:, 2:], 1)
        return np.where(np.isnan(passed)[:, None], self.last[:, 1:], ahead)


def none_live() -> Live:
    return Live(np.zeros(0, np.int64), np.zeros((0, 5)), np.zeros((0, 5)))


def kinds(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first of each different row, and the numbers of all that equal it, in order."""
    if len(rows) == 1:
        return np.zeros(1, np.int64), [np.zeros(1, np.int64)]
    _, first, kind = np.unique(np.ascontiguousarray(rows + 0.0).view(f"V{rows.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    return first, np.split(order, np.flatnonzero(np.diff(kind[order])) + 1)


def likeness(boxes: np.ndarray, guesses: np.ndarray) -> np.ndarray:
    """How well each box (row) fits each guess (column); -inf where it does not at all."""
    a, b = boxes[:, None], guesses[None]
    shared = np.clip(np.minimum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0, None).prod(-1)
    union = a[..., 2:].prod(-1) + b[..., 2:].prod(-1) - shared
    overlap = np.divide(shared, union, out=np.zeros_like(shared), where=shared > 0)
    centres = (a[..., :2] + a[..., 2:] / 2) - (b[..., :2] + b[..., 2:] / 2)
    distance = np.hypot(centres[..., 0], centres[..., 1]) / np.maximum(a[..., 2:].max(-1), b[..., 2:].max(-1))
    return np.where((overlap > LEAST_OVERLAP) | (distance < MOST_DISTANCE), overlap - DISTANCE_WEIGHT * distance, -math.inf)


#: Pairs of boxes and tracks that are compared at a time.
PAIRS = 1 << 20


def fits(t: float, boxes: np.ndarray, live: Live) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of boxes and tracks that fit at all: ``(box, track, fit)``."""
    ahead, last = live.expected(t), live.last[:, 1:]
    step, parts = max(1, PAIRS // len(last)), []
    for at in range(0, len(boxes), step):
        some = boxes[at : at + step]
        fit = np.maximum(likeness(some, ahead), likeness(some, last))
        row, column = np.nonzero(fit > -math.inf)
        parts.append((row + at, column, fit[row, column]))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def matched(t: float, boxes: np.ndarray, live: Live) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one pairs of boxes and tracks, best fit first; of equal ones, the first box and track.

    Boxes that are equal fit alike, and so do tracks that were seen alike, so both are compared by
    kinds: copies add no pairs."""
    if not len(live.track):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(boxes) == 1:
        guesses = likeness(boxes, np.concatenate([live.expected(t), live.last[:, 1:]]))[0]
        fit = np.maximum(guesses[: len(live.track)], guesses[len(live.track) :])
        best = np.flatnonzero(fit == fit.max())[:1] if fit.max() > -math.inf else np.zeros(0, np.int64)
        return np.zeros(len(best), np.int64), best
    box, rows = kinds(boxes)
    track, columns = kinds(np.hstack([live.last, live.before]))
    a, b, fit = fits(t, boxes[box], live.at(track))
    order = np.argsort(-fit, kind="stable")
    a, b = a[order].tolist(), b[order].tolist()
    ends = [*(np.flatnonzero(np.diff(fit[order])) + 1).tolist(), len(a)]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    for end in ends if a else []:
        if end - at == 1:  # one kind of box and one of track fit so well: in their order
            n = min(len(rows[a[at]]), len(columns[b[at]]))
            if n:
                pairs.append((rows[a[at]][:n], columns[b[at]][:n]))
                rows[a[at]], columns[b[at]] = rows[a[at]][n:], columns[b[at]][n:]
        else:
            with_: dict[int, list[int]] = {}
            for x, y in zip(a[at:end], b[at:end], strict=True):
                if len(rows[x]) and len(columns[y]):
                    with_.setdefault(x, []).append(y)
            taken, place = set(), {y: 0 for ys in with_.values() for y in ys}
            for row, x in sorted((r, x) for x in with_ for r in rows[x].tolist()):
                free_ = [y for y in with_[x] if place[y] < len(columns[y])]
                if free_:
                    y = min(free_, key=lambda y: columns[y][place[y]])
                    taken.add(row)
                    pairs.append((np.array([row]), columns[y][place[y] : place[y] + 1]))
                    place[y] += 1
                with_[x] = free_
            for x in with_:
                rows[x] = np.array([r for r in rows[x].tolist() if r not in taken], np.int64)
            for y, n in place.items():
                columns[y] = columns[y][n:]
        at = end
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*pairs, strict=True)))


def advanced(live: Live, made: int, t: float, boxes: np.ndarray, max_gap: float) -> tuple[Live, int, np.ndarray]:
    """The live tracks after the boxes found at ``t``, how many tracks were made, and each box's track."""
    fresh = t - live.last[:, 0] <= max_gap
    live, out = live if fresh.all() else live.at(fresh), np.zeros(len(boxes), np.int64)
    now = np.empty((len(boxes), 5))
    now[:, 0], now[:, 1:] = t, boxes
    row, column = matched(t, boxes, live)
    if len(row):
        live = Live(live.track, live.last.copy(), live.before.copy())
        live.before[column], live.last[column] = live.last[column], now[row]
        out[row] = live.track[column]
    new = np.flatnonzero(out == 0)
    if len(new):
        out[new] = made + 1 + np.arange(len(new))
        live = Live(np.concatenate([live.track, out[new]]), np.concatenate([live.last, now[new]]), np.concatenate([live.before, np.full((len(new), 5), np.nan)]))
    return live, made + len(new), out


def numbered(parts, group: str, max_gap: float):
    """Adds ``track`` to frames sorted by group and time; a step cut by the end of a frame
    waits for its rest."""
    live, here, made, waiting = none_live(), None, 0, None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nonlocal live, here, made
        found = np.zeros(len(frame), np.int64)
        groups, ts, boxes = frame[group].to_numpy(), frame["t"].to_numpy(float), frame[SIDES].to_numpy(float)
        changes = (np.flatnonzero((groups[1:] != groups[:-1]) | (ts[1:] != ts[:-1])) + 1).tolist()
        for first, end in zip([0, *changes], [*changes, len(frame)], strict=True):
            if groups[first] != here:
                live, here, made = none_live(), groups[first], 0
            live, made, found[first:end] = advanced(live, made, float(ts[first]), boxes[first:end], max_gap)
        return frame.assign(track=found)

    for part in parts:
        frame = part if waiting is None else pd.concat([waiting, part], ignore_index=True)
        if not len(frame):
            continue
        last = (frame[group] == frame[group].iloc[-1]) & (frame["t"] == frame["t"].iloc[-1])
        waiting = frame[last].reset_index(drop=True)
        if not last.all():
            yield run(frame[~last].reset_index(drop=True))
    if waiting is not None and len(waiting):
        yield run(waiting)


def tracks(found: DataFrame, by: str, order: str, max_gap: float = MAX_GAP) -> DataFrame:
    """``(by, order, t, x, y, w, h, score, scene, track)``: each detection with its track.

    No track outlives ``max_gap``, so a video falls into scenes wherever nothing is found for
    longer; scenes are what is dealt to tasks, and tracks are numbered within them. ``order``
    (unique within a video) ranks the detections of one time. Rows with a null key, time or
    side take no part."""
    rows = found.select(by, order, F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in [*SIDES, "score"]]).dropna(subset=[by, "t", *SIDES])
    video = Window.partitionBy(by).orderBy("t", order)
    cut = F.coalesce(F.col("t") - F.lag("t").over(video) > max_gap, F.lit(True)).cast("long")
    rows = rows.withColumn("scene", F.sum(cut).over(video.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__group", F.xxhash64(by, "scene"))
    # A set number of tasks: tracking is work in Python, and few bytes would be few tasks.
    spark = found.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(tasks, by, "scene").sortWithinPartitions("__group", by, "scene", "t", order)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInPandas(lambda parts: numbered(parts, "__group", max_gap), f"{kind}, track long").drop("__group")


def kept(tracked: DataFrame, by: list[str], order: str, least: float = LONE_SCORE) -> DataFrame:
    """The tracks seen more than once, or once with a good score."""
    n = free(tracked, "n")
    return tracked.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*by))).where((F.col(n) > 1) | (F.col("score") >= least)).drop(n)


def boxes_at(tracked: DataFrame, by: list[str], times: DataFrame, on: list[str], lead: float = LEAD, hold: float = HOLD) -> DataFrame:
    """Each track's box at each of ``times`` (columns ``on``, a subset of ``by``, and ``t``; further
    columns are kept): between detections on a straight line, before the first one by ``lead``
    seconds and after the last one by ``hold`` seconds as it was there; no row outside.

    Times meet a track's life by ``on`` and by bins of time as wide as a lone detection's life, so a video of many
    tracks is many keys; the detections around a time are then found in one sorted pass over
    both, without a join of times with detections."""
    extra = [c for c in times.columns if c not in {*on, "t"}]
    wide = (lead + hold) or 1.0
    life = tracked.groupBy(*by).agg(F.min("t").alias("__from"), F.max("t").alias("__to"))
    life = life.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("__from") - lead) / wide), F.floor((F.col("__to") + hold) / wide))))
    asked = times.withColumn("__bin", F.floor(F.col("t") / wide)).join(life, [*on, "__bin"])
    asked = asked.where((F.col("t") >= F.col("__from") - lead) & (F.col("t") <= F.col("__to") + hold)).select(*by, "t", *extra, F.lit(1).alias("__asked"))
    key = F.struct("t", *SIDES)
    both = tracked.select(*by, "t", key.alias("__key"), F.lit(0).alias("__asked")).unionByName(asked, allowMissingColumns=True)
    line = Window.partitionBy(*by).orderBy("t", "__asked")
    both = both.withColumn("a", F.last("__key", True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("b", F.first("__key", True).over(line.rowsBetween(0, Window.unboundedFollowing))).where("__asked = 1")
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    at = lambda c: F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share)
    return both.select(*by, "t", *extra, *[at(c).alias(c) for c in SIDES])


def covers_at(tracked: DataFrame, by: list[str], times: DataFrame, on: list[str], lead: float = LEAD, hold: float = HOLD, trail: float = TRAIL) -> DataFrame:
    """What to hide of each track at each of ``times``: its boxes at five times from ``trail``
    seconds before to ``trail`` after, joined into one."""
    around = times.select(*on, F.col("t").alias("at")).distinct().select(*on, "at", F.explode(F.array(*[F.lit(trail * k / 2) for k in range(-2, 3)])).alias("__d"))
    boxes = boxes_at(tracked, by, around.select(*on, "at", (F.col("at") + F.col("__d")).alias("t")), on, lead, hold)
    ends = boxes.groupBy(*by, "at").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("__r"), F.max(F.col("y") + F.col("h")).alias("__b"))
    return ends.select(*by, F.col("at").alias("t"), "x", "y", (F.col("__r") - F.col("x")).alias("w"), (F.col("__b") - F.col("y")).alias("h"))


def apart(a: str, b: str) -> Column:
    """The distance of two boxes' centres, in sizes of the larger."""
    mid = lambda s, o, d: F.col(f"{s}.{o}") + F.col(f"{s}.{d}") / 2
    size = F.greatest(*[F.col(f"{s}.{d}") for s in (a, b) for d in ("w", "h")])
    return F.hypot(mid(a, "x", "w") - mid(b, "x", "w"), mid(a, "y", "h") - mid(b, "y", "h")) / size


def parents(tracked: DataFrame, on: list[str], track: list[str], lead: float = 0.5, hold: float = 1.0) -> DataFrame:
    """``(on, track, parent)``: each short track that stays beside a long one of its video all
    along, and the one it is nearest to in sum. ``track`` is one or two columns."""
    by, name = [*on, *track], F.struct(*track)
    # Tracks of the same detections have the same parent, and of such parents the first counts:
    # both are compared once a kind. Its signature: detections, two hashes of each, all joined.
    one = lambda *salt: F.xxhash64(*[F.lit(x) for x in salt], "t", *SIDES)
    signed = [F.count(F.lit(1)).alias("__n"), F.bit_xor(one()).alias("__s1"), F.bit_xor(one(1)).alias("__s2")]
    kind = ["__n", "__s1", "__s2"]
    all_tracks = tracked.groupBy(*by).agg((F.max("t") - F.min("t")).alias("__span"), *signed)
    first = all_tracks.groupBy(*on, *kind).agg(F.min(name).alias("__first"), F.first("__span").alias("__span"))
    first = first.select(*on, *[F.col(f"__first.{c}").alias(c) for c in track], *kind, "__span")
    long = tracked.join(first.where(F.col("__span") > SHORT).select(*by), by)
    short = tracked.join(first.where(F.col("__span") <= SHORT).select(*by, *kind), by).select(*on, "t", F.struct(*kind).alias("child"), F.struct(*SIDES).alias("own"), "__n")
    beside = boxes_at(long, by, short, on, lead, hold).withColumn("box", F.struct(*SIDES)).withColumn("__d", apart("own", "box"))
    fits = beside.groupBy(*on, "child", name.alias("parent")).agg(F.sum("__d").alias("total"), F.max("__d").alias("most"), F.count(F.lit(1)).alias("seen"), F.first("__n").alias("all"))
    best = fits.where((F.col("most") <= NEAR) & (F.col("seen") == F.col("all"))).groupBy(*on, "child").agg(F.min_by("parent", F.struct("total", "parent")).alias("parent"))
    best = all_tracks.join(best.select(*on, *[F.col(f"child.{c}").alias(c) for c in kind], "parent"), [*on, *kind])
    return best.select(*by, *[F.col(f"parent.{c}").alias(f"parent_{c}") for c in track])


def shown(covers: DataFrame, parents: DataFrame, off: DataFrame, on: list[str], track: list[str]) -> DataFrame:
    """The covers of tracks that are not switched off; a track with a parent has its parent's
    switch. ``off`` has the columns ``on`` and ``track``; ``parents`` is the result of that name."""
    led = covers.join(parents.select(*on, *track, *[F.col(f"parent_{c}").alias(f"__{c}") for c in track]), [*on, *track], "left")
    led = led.withColumns({f"__{c}": F.coalesce(f"__{c}", c) for c in track})
    gone = off.select(*on, *[F.col(c).alias(f"__{c}") for c in track]).distinct()
    return led.join(gone, [*on, *[f"__{c}" for c in track]], "left_anti").select(*covers.columns)
