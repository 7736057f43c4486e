"""The tracker as a streaming operator: detections come in as they are found, in any order within
the watermark, and leave with their track once no earlier one can come any more.

Per video the state is the detections that still wait, and the live tracks (the last two boxes of
each). A timer on event time does the rest: at the time of the first detection that waits all steps up to
the watermark are complete, and are tracked in order; ``max_gap`` after the last one the scene is over and the state is
gone. So it is bounded by what is found within the delay and the gap, however long a video is
or however many there are, and lives under the checkpoint folder with the query's progress.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tracking import MAX_GAP, SIDES, Live, advanced, none_live

#: State in RocksDB, which transformWithState needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BOX = ", ".join(f"{c} double" for c in SIDES)
BEFORE = ", ".join(f"before_{c} double" for c in ["t", *SIDES])


class Tracks(StatefulProcessor):
    """One video's tracks. Input rows: the key, ``ts``, ``order`` and the box with its score."""

    def __init__(self, by: str, max_gap: float):
        self.by, self.max_gap = by, max_gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, n long, {BOX}, score double")
        self.live = handle.getListState("live", f"track long, t double, {BOX}, {BEFORE}")
        self.scene = handle.getValueState("scene", "first long, last long, made long")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            found = frame.dropna(subset=SIDES)  # a row without a box only moves time on
            if len(found):
                us = found["ts"].astype("datetime64[us]").astype("int64")
                self.waiting.appendList(list(zip(us.tolist(), found["n"].tolist(), *[found[c].astype(float).tolist() for c in [*SIDES, "score"]], strict=True)))
                least = int(us.min()) if least is None else min(least, int(us.min()))
        if least is not None:
            self.wake(-(-least // 1000))
        return iter([])

    def wake(self, ms: int) -> None:
        """One timer, at the first time that there is something to do."""
        (old,) = self.timer.get() if self.timer.exists() else (None,)
        if old is None or ms < old:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All up to the watermark is complete, not only what is due at the timer's time.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if self.timer.exists() and self.timer.get()[0] <= now:
            self.timer.clear()
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["us", "n", *SIDES, "score"])
        due, later = rows[rows["us"] <= now * 1000].sort_values(["us", "n"]), rows[rows["us"] > now * 1000]
        first, last, made = self.scene.get() if self.scene.exists() else (None, None, 0)
        if len(due):
            if len(later):
                self.waiting.put(list(later.itertuples(index=False, name=None)))
            else:
                self.waiting.clear()
            kept = np.array([[math.nan if v is None else v for v in r] for r in (self.live.get() if self.live.exists() else [])], float).reshape(-1, 11)
            live = Live(kept[:, 0].astype(np.int64), kept[:, 1:6], kept[:, 6:])
            us, boxes = due["us"].to_numpy(np.int64), due[SIDES].to_numpy(float)
            scenes, tracks = np.zeros(len(due), np.int64), np.zeros(len(due), np.int64)
            changes = (np.flatnonzero(us[1:] != us[:-1]) + 1).tolist()
            for at, end in zip([0, *changes], [*changes, len(due)], strict=True):
                t = int(us[at])
                if last is None or t / 1e6 - last / 1e6 > self.max_gap:
                    live, first, made = none_live(), t, 0
                live, made, tracks[at:end] = advanced(live, made, t / 1e6, boxes[at:end], self.max_gap)
                last, scenes[at:end] = t, first
            if now < self.over(last):
                some = lambda v: [None if math.isnan(x) else x for x in v]
                self.live.put([(int(k), *a, *some(b)) for k, a, b in zip(live.track.tolist(), live.last.tolist(), live.before.tolist(), strict=True)])
                self.scene.update((int(first), int(last), int(made)))
            yield pd.DataFrame({self.by: key[0], "ts": pd.to_datetime(due["us"], unit="us"), "n": due["n"], **{c: due[c] for c in [*SIDES, "score"]}, "scene": pd.to_datetime(scenes, unit="us"), "track": tracks}).reset_index(drop=True)
        if last is not None and now >= self.over(last):
            self.live.clear()
            self.scene.clear()
        elif last is not None:
            self.wake(self.over(last))
        if len(later):
            self.wake(-(-int(later["us"].min()) // 1000))

    def over(self, last: int) -> int:
        return -(-(last + math.ceil(self.max_gap * 1e6)) // 1000)


def tracks(stream: DataFrame, by: str, ts: str, order: str, max_gap: float = MAX_GAP, late: str = "10 seconds") -> DataFrame:
    """``(by, ts, order, x, y, w, h, score, scene, track)``: each detection with its track, as the batch
    operator of that name gives them, but that a scene is named by the time it begins.

    Detections later than ``late`` behind the newest are dropped, by the watermark. Rows with a null
    key or time take no part; rows with a null side only move time on, which is how a source that has
    nothing to tell gets its last detections out. Times lie before
    2262. The session needs the settings in ``STORE``."""
    sides = [F.col(c).cast("double").alias(c) for c in [*SIDES, "score"]]
    rows = stream.select(by, F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("long").alias("n"), *sides).dropna(subset=[by, "ts"])
    kind = rows.schema[by].dataType.simpleString()
    told = f"`{by}` {kind}, ts timestamp, n long, {BOX}, score double, scene timestamp, track long"
    found = rows.withWatermark("ts", late).groupBy(by).transformWithStateInPandas(Tracks(by, max_gap), told, "Append", "EventTime")
    return found.withColumnsRenamed({"ts": ts, "n": order})
