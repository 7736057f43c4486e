import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe import catalog
from hushframe.functions.spans import scan
from hushframe.operators import layout, screens, tracking
from hushframe.streaming import jobs

ITEM = "p int, n int, str string, x double, y double, width double, size double, eol boolean"


def test_page_text(spark):
    rows = [
        (1, 0, "Jane", 0.0, 100.0, 24.0, 10.0, False),
        (1, 1, "Doe", 24.5, 100.0, 18.0, 10.0, False),  # no gap
        (1, 2, "", 50.0, 100.0, 0.0, 10.0, True),  # ends the line
        (1, 3, "x ", 0.0, 100.0, 8.0, 10.0, False),
        (1, 4, "y", 30.0, 50.0, 6.0, 10.0, True),  # a space is there already
        (1, 5, None, 0.0, 0.0, 0.0, 10.0, None),
        (1, 6, "z", 0.0, 50.0, 6.0, 10.0, False),
        (2, 0, "a", 0.0, 9.0, 6.0, 10.0, False),
        (2, 1, "b", 9.0, 9.0, 6.0, 10.0, False),
        (2, 2, "c", 9.0, 0.0, 6.0, 10.0, False),
        (None, 0, "d", 0.0, 0.0, 6.0, 10.0, False),
    ]
    parts = layout.page_parts(spark.createDataFrame(rows, ITEM), ["p"], eol="eol")
    texts = {r["p"]: r["text"] for r in layout.page_text(parts, ["p"]).collect()}
    assert texts == {1: "JaneDoe\nx y\nz", 2: "a b\nc", None: "d"}
    for r in parts.collect():
        assert texts[r["p"]][r["start"] : r["end"]] == r["str"]


def test_rects(spark):
    rows = [(1, 0, "Jane", 0.0, 100.0, 24.0, 10.0, False), (1, 1, "Doe", 28.0, 100.0, 18.0, 10.0, False), (1, 2, "far", 200.0, 100.0, 18.0, 10.0, False), (1, 3, "low", 0.0, 50.0, 18.0, 10.0, False)]
    parts = layout.page_parts(spark.createDataFrame(rows, ITEM), ["p"])
    spans = spark.createDataFrame([(1, 2, 20, "NAME")], "p int, start int, end int, tag string")
    rects = layout.span_rects(spans, parts, ["p"], ["tag"])
    found = sorted((r["n"], round(r["x0"], 2), round(r["y0"], 2), round(r["x1"], 2), round(r["y1"], 2)) for r in rects.collect())
    assert found == [(0, 10, 97.2, 26, 109.5), (1, 26, 97.2, 48, 109.5), (2, 198, 97.2, 220, 109.5), (3, -2, 47.2, 20, 59.5)]
    bars = sorted((round(r["x0"]), round(r["x1"])) for r in layout.merged_rects(rects, ["p", "start"]).collect())
    assert bars == [(-2, 20), (10, 48), (198, 220)]


def plain_tracks(rows, max_gap):
    """The tracker in so many words, over one video's ``(t, n, x, y, w, h)``."""
    tracks, out = [], {}

    def guess(keys, t):
        if len(keys) < 2:
            return keys[-1][1]
        (t0, a), (t1, b) = keys[-2:]
        k = min(2, (t - t1) / (t1 - t0))
        moved = [q + (q - p) * k for p, q in zip(a, b, strict=True)]
        return (*moved[:2], max(1, moved[2]), max(1, moved[3]))

    def fit(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        both = w * h if w > 0 and h > 0 else 0
        over = both / (a[2] * a[3] + b[2] * b[3] - both)
        d = math.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2) / max(*a[2:], *b[2:])
        return over - d / 2 if over > 0.1 or d < 1 else None

    for t in sorted({r[0] for r in rows}):
        step = sorted(r for r in rows if r[0] == t)
        live = [k for k in tracks if t - k[-1][0] <= max_gap]
        pairs = []
        for i, r in enumerate(step):
            for j, k in enumerate(live):
                fits = [f for f in (fit(r[2:], guess(k, t)), fit(r[2:], k[-1][1])) if f is not None]
                if fits:
                    pairs.append((-max(fits), i, j))
        mine, used = {}, set()
        for _, i, j in sorted(pairs):
            if i not in mine and j not in used:
                mine[i] = live[j]
                used.add(j)
        for i, r in enumerate(step):
            if i not in mine:
                tracks.append([])
                mine[i] = tracks[-1]
            mine[i].append((t, r[2:]))
            out[r[1]] = next(n for n, k in enumerate(tracks) if k is mine[i])
    return out


def boxes(seed, steps=60):
    r = random.Random(seed)
    movers, rows, n = [[r.uniform(0, 300), r.uniform(0, 200), r.uniform(-9, 9), r.uniform(-5, 5)] for _ in range(4)], [], 0
    for s in range(steps):
        for m in movers:
            m[0] += m[2]
            m[1] += m[3]
            if r.random() < 0.8 and s % 20 < 15:
                rows.append((s * 0.25, n, m[0], m[1], 30 + r.random(), 40 + r.random()))
                n += 1
    return rows


def test_tracks_like_plain_tracker(spark):
    data = {v: boxes(v) for v in range(3)}
    rows = [(v, n, t, x, y, w, h, 0.5) for v, rs in data.items() for t, n, x, y, w, h in rs]
    table = spark.createDataFrame([*rows, (None, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.5), (0, 9999, None, 0.0, 0.0, 1.0, 1.0, 0.5)], "v int, n int, t double, x double, y double, w double, h double, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # steps are cut by batches
    try:
        got = tracking.tracks(table, "v", "n", 1.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for v, rs in data.items():
        want, seen = plain_tracks(rs, 1.0), {r["n"]: (r["scene"], r["track"]) for r in got if r["v"] == v}
        assert len(set(want.values())) == len(set(seen.values())) == len({(want[n], seen[n]) for n in want})


@pytest.mark.parametrize("copies", [1, 3, 40])
def test_copies_are_matched_by_kinds(copies, monkeypatch):
    """Copies of boxes get the tracks of the plain tracker, and add no pairs that are compared."""
    rows, compared = [], []
    for t, n, x, y, w, h in boxes(5, 12):
        rows += [(t, n * copies + k, float(round(x / 8) * 8), float(round(y / 8) * 8), 32.0, 40.0) for k in range(copies)]
    if copies == 3:  # copies that go on by different ways, and kinds that fit as well as others
        rows = [(t, n, x + (8 if n % 7 == 0 else 0), y, w, h) for t, n, x, y, w, h in rows]
    plain, live, made, got = plain_tracks(rows, 1.0), tracking.none_live(), 0, {}
    like = tracking.likeness
    monkeypatch.setattr(tracking, "likeness", lambda a, b: compared.append(len(a) * len(b)) or like(a, b))
    for t in sorted({r[0] for r in rows}):
        step = sorted(r for r in rows if r[0] == t)
        live, made, found = tracking.advanced(live, made, t, np.array([r[2:] for r in step]), 1.0)
        got |= dict(zip([r[1] for r in step], found.tolist(), strict=True))
    assert got == {n: k + 1 for n, k in plain.items()}
    assert copies != 40 or sum(compared) < 40 * len(rows)


KEYS = "v int, k int, t double, x double, y double, w double, h double, score double"


def test_boxes_and_covers(spark):
    keys = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 2.0, 10.0, 4.0, 20.0, 10.0, 0.9)], KEYS)
    times = spark.createDataFrame([(1, t) for t in (0.5, 0.9, 1.0, 1.25, 2.0, 2.5, 2.6)] + [(2, 1.0)], "v int, t double")
    got = {r["t"]: (r["x"], r["y"], r["w"], r["h"]) for r in tracking.boxes_at(keys, ["v", "k"], times, ["v"]).collect()}
    assert got == {0.9: (0, 0, 10, 10), 1.0: (0, 0, 10, 10), 1.25: (2.5, 1, 12.5, 10), 2.0: (10, 4, 20, 10), 2.5: (10, 4, 20, 10)}
    cover = tracking.covers_at(keys, ["v", "k"], times.where("t = 1.0"), ["v"]).collect()
    assert len(cover) == 1 and [round(cover[0][c], 3) for c in ("x", "y", "w", "h")] == [0, 0, 18, 11.6]


def test_kept_and_parents(spark):
    long = [(1, 1, i * 0.25, 0.0, 0.0, 20.0, 20.0, 0.9) for i in range(12)]
    beside = [(1, 2, 1.0, 15.0, 0.0, 20.0, 20.0, 0.3), (1, 2, 1.25, 15.0, 0.0, 20.0, 20.0, 0.3)]
    leaves = [(1, 3, 1.0, 15.0, 0.0, 20.0, 20.0, 0.3), (1, 3, 1.25, 90.0, 0.0, 20.0, 20.0, 0.3)]
    lone = [(1, 4, 2.0, 200.0, 0.0, 20.0, 20.0, 0.3), (1, 5, 2.0, 300.0, 0.0, 20.0, 20.0, 0.7)]
    table = spark.createDataFrame(long + beside + leaves + lone, KEYS)
    assert {r["k"] for r in tracking.kept(table, ["v", "k"], "t").collect()} == {1, 2, 3, 5}
    assert [(r["k"], r["parent_k"]) for r in tracking.parents(table, ["v"], ["k"]).collect()] == [(2, 1)]
    empty = tracking.tracks(spark.createDataFrame([], KEYS), "v", "k")
    assert empty.count() == 0 and "track" in empty.columns


def test_bands(spark):
    first = [(1, 0, y, [0] * 4) for y in range(12)]
    then = [(1, 1, y, [25, 25, 0, 0] if y in (0, 4, 9) else [24, 99, 0, 0] if y == 6 else [0] * 4) for y in range(12)]
    got = screens.changed_bands(spark.createDataFrame(first + then, "v int, n int, y int, gray array<int>"), "v", F.lit(12)).collect()
    assert sorted((r["n"], r["y0"], r["y1"]) for r in got) == [(1, 0, 6), (1, 8, 11)]


def test_typed_from(spark):
    shots = spark.createDataFrame([(1, 0, "jo x", 0), (1, 1, "hi", 0), (1, 2, "to Jord", 0), (1, 3, "to jordan@ex", 0), (1, 4, "to jordan@example.com", 0), (2, 0, "ann@", 5), (2, 1, "ann@example.com", 9)], "v int, n int, text string, scroll int")
    firsts = spark.createDataFrame([(1, 4, "a", "jordan@example.com"), (2, 1, "b", "ann@example.com"), (1, 4, "c", "short")], "v int, n int, item string, value string")
    got = screens.typed_from(shots, firsts, "v").collect()
    assert [(r["v"], r["item"], r["shown"], r["since"]) for r in got] == [(1, "a", 4, 2)]


def test_items_and_scroll(spark):
    rows = [(1, 0, "T", "A  b"), (1, 0, "T", "a b"), (1, 3, "T", "a\nb"), (1, 1, "U", None)]
    got = screens.items(spark.createDataFrame(rows, "v int, t int, tag string, value string"), "v", "t").where("item IS NOT NULL").collect()
    assert [(r["item"], r["first"], r["last"], r["most"]) for r in got] == [("T:a b", 0, 3, 2)]
    frames = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, -2)], "v int, t int, d int")
    assert [r["scroll"] for r in screens.scrolled(frames, "v", "t", "d").orderBy("t").collect()] == [0, 5, 3]


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda first: pd.DataFrame({"id": range(first, first + 3), "text": ["a@b.co", None, ""], "ts": [dt.datetime(2024, 1, 1, h) for h in (0, 0, 1)]})
    for first in (0, 3):  # the second run takes up what the first has not seen
        spark.createDataFrame(rows(first)).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.files(spark, source)
        jobs.mask_to(stream, f"{out}/masked", f"{out}/c1").awaitTermination()
        jobs.updates_to(jobs.windowed(stream, "ts", [], late="10 days"), f"{out}/counts", f"{out}/c2").awaitTermination()
    masked = {r["id"]: r["text"] for r in spark.read.parquet(f"{out}/masked").collect()}
    assert masked == {0: "[EMAIL]", 1: None, 2: "", 3: "[EMAIL]", 4: None, 5: ""}
    assert sorted(r["n"] for r in jobs.latest(spark, f"{out}/counts", []).collect()) == [2, 4]


def test_unknown_style(spark):
    with pytest.raises(ValueError):
        jobs.mask_to(spark.createDataFrame([("a",)], "text string"), "x", "y", style="none")


def test_pages_in_arrays_equal_pages_in_rows(spark):
    rng = random.Random(5)
    words = ["ab@c.org", "x", "a ", " b", "c\n", "née", "w" * 9]
    rows = [(p, n, rng.choice(words), rng.randint(0, 9) * 5.0, rng.randint(0, 2) * 4.0, rng.randint(1, 9) * 2.0, 10.0, False) for p in range(20) for n in range(rng.randint(1, 600))]
    items = spark.createDataFrame(rows, ITEM).drop("eol")
    email = lambda t: scan(t, r"[a-z]+@[a-z.]+", "EMAIL")
    parts = layout.page_parts(items, ["p"])
    texts = layout.page_text(parts, ["p"])
    want = layout.span_rects(texts.select("p", F.explode(email(F.col("text"))).alias("s")).select("p", "s.start", "s.end"), parts, ["p"], [])
    pages = items.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("n", "str", "x", "y", "width", "size"))).alias("items"))
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(pages.select("p", F.array_join(layout.pieces(F.col("items")), ""))) == rows_of(texts)
    got = layout.page_boxes(pages, ["p"], email)
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    places = pages.select("p", F.explode(layout.arranged(F.col("items"))).alias("a")).select("p", "a.item.n", "a.start", "a.end")
    assert rows_of(places) == rows_of(parts.select("p", "n", "start", "end"))


@pytest.mark.parametrize(("name", "most"), [("page_texts", 0), ("page_rects", 0), ("turned_rects", 0), ("line_places", 1)])
def test_words_of_pages_are_not_shuffled_or_sorted_again(spark, name, most):
    """The items of a page come from one document: at most one shuffle and sort of them."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") <= 2 * most
    assert plan.count("+- Sort [id") <= most


def test_texts_of_words_that_lie_together_need_no_shuffle(spark):
    from hushframe.operators import words as W
    from hushframe.plans import layouts

    rng = random.Random(8)
    strs = ["Ab.", "com", "7", "漢", "字", "-", "é@", "long"]
    rows = [(f"p{k // 60}", k, rng.choice(strs), rng.randrange(12) * 20.0, rng.randrange(8) * 9.0, rng.choice([5.0, 25.0, 60.0]), rng.choice([0.0, 8.0, 10.0, 40.0]), float(rng.randrange(40, 100))) for k in range(900)]
    words = spark.createDataFrame(rows, "id string, n int, str string, x double, y double, w double, h double, conf double").coalesce(1)
    apart = W.text_of(W.word_parts(W.merged_lines(words, "id"), "id"), "id").collect()
    together = W.read_texts(words.sortWithinPartitions("n"), "id")
    assert len(apart) == 15 and sorted(together.collect()) == sorted(apart)
    plan = layouts.read_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan


@pytest.mark.parametrize("crowd, rounds", [(16, 16), (0, 16), (16, 0)])
def test_words_of_many_pictures_like_those_of_each(monkeypatch, crowd, rounds):
    """Rows apart and rows that run into each other, equal and mixed heights, one tall box, no places."""
    from hushframe.operators import words as W

    monkeypatch.setattr(W, "CROWD", crowd)
    monkeypatch.setattr(W, "ROUNDS", rounds)
    rng = random.Random(crowd + 7 * rounds)
    for turn in range(40):
        of, rows = [], []
        for page in range(rng.randint(1, 12)):
            heights, step = rng.choice([([10.0], 12.0), ([10.0], 10.0), ([8.0, 10.0, 12.0], 9.0), ([9.0, 10.0], 15.0), ([0.0, 10.0, 60.0], 7.0), ([0.0], 3.0)])
            for _ in range(rng.randint(1, 60)):
                x = rng.choice([rng.randrange(12) * 20.0, rng.uniform(0, 200)])
                y = rng.randrange(8) * step + rng.choice([0.0, 0.0, 1.0])
                rows.append((x, y, rng.choice([5.0, 25.0, 0.0, 60.0]), rng.choice(heights), float(rng.randrange(50, 53))))
                of.append(page)
            if rng.random() < 0.2:
                rows.append((0.0, 0.0, 300.0, 500.0, 51.0))
                of.append(page)
        of, columns = np.array(of), [np.array(c) for c in zip(*rows, strict=True)]
        kept = W.surest_all(of, *columns)
        lines = W.lined_all(of, *columns[:4])
        odd = [c.copy() for c in columns[:4]]
        odd[turn % 4][::17] = [np.nan, np.inf, -1.0, -np.inf][turn // 4 % 4]
        odd_lines = W.lined_all(of, *odd)
        for page in range(of.max() + 1):
            i = np.flatnonzero(of == page)
            boxes = lambda cs: list(zip(*(c[i].tolist() for c in cs), strict=True))  # noqa: B023, E731
            assert np.flatnonzero(kept[i]).tolist() == sorted(W.surest(boxes(columns[:4]), columns[4][i]))
            assert lines[i].tolist() == W.lined(boxes(columns[:4])).tolist()
            assert odd_lines[i].tolist() == W.lined(boxes(odd)).tolist()


def test_texts_of_pictures_that_are_a_row_each(spark):
    """As of rows of words; no word of a document is a row of its own."""
    from hushframe.operators import words as W
    from hushframe.plans import layouts

    rng = random.Random(4)
    strs = ["Ab.", "com", "7", "漢", "字", "-", "é@", "long", "漢\n", "5\n", "9漢", "漢.", "ก", "", "٣", "a ", "漢\u0085", None, "Zoë", "ß7"]
    pages, rows = [(None, ["a"], [1.0], [1.0], [1.0], [1.0], [90.0]), ("none", [], [], [], [], [], []), ("null", None, None, None, None, None, None)], []
    for page in range(200):
        words = []
        for _ in range(rng.randint(1, 40)):
            s = rng.choice(strs)
            for _ in range(2):
                words.append((s, rng.randrange(12) * 20.0, rng.randrange(8) * 9.0, rng.choice([5.0, 25.0, 60.0]), rng.choice([0.0, 8.0, 10.0, 40.0]), float(rng.randrange(40, 100))))
                if rng.random() < 0.03:
                    words[-1] = (s, *[rng.choice([None, v, math.nan]) for v in words[-1][1:5]], rng.choice([None, math.nan, 60.0]))
        pages.append((f"p{page}", [w[0] for w in words[::2]], *[[w[c] for w in words] for c in range(1, 6)]))
        rows += [(f"p{page}", k, *w) for k, w in enumerate(words)]
    numbers = ", ".join(f"{c} array<double>" for c in ("x", "y", "w", "h", "conf"))
    got = W.read_texts_in(spark.createDataFrame(pages, f"id string, str array<string>, {numbers}"), "id", 2).collect()
    apart = spark.createDataFrame(rows, "id string, n int, str string, x double, y double, w double, h double, conf double").coalesce(1)
    want = W.text_of(W.word_parts(W.merged_lines(apart, "id"), "id"), "id").collect()
    assert sorted(got) == sorted(want) and len(want) > 150
    plan = layouts.read_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_words_of_a_page_are_no_rows(spark):
    from hushframe.plans import layouts

    plan = layouts.read_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "MapInArrow" in plan
