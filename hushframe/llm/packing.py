"""Best-fit packing of token sequences by bin completion.

Documents are tokenized, closed by an end id, and cut only if longer than a sequence. What
is to be packed is then told by a histogram: how many pieces there are of each length. It
has at most as many entries as a sequence has tokens, however large the corpus, so the
branch-and-bound search runs on it alone:

* the largest piece left must go somewhere; all fillings that complete its sequence are
  enumerated as they are asked for, largest pieces first, but for dominated ones: a filling is
  dominated if a piece left over could be added, or could replace a smaller one (or two) in it;
* a filling is applied to as many sequences as its pieces allow, then to one less, and so on, and no
  more to others that begin with the same piece;
* branches that can't beat the incumbent, by the total length left (every sequence wasted
  so far counts), are pruned; the first incumbent is best-fit decreasing; a solution at the
  bound, or the end of all branches, proves the plan to be the best of its kind.

The search may take a number of steps (fillings looked at) that the caller sets; the best
plan so far is kept where they run out, and ``search`` tells whether that was so.

Pieces then take their places: the pieces of a length are ranked, and the plan says for
each range of ranks which sequences, and which place in them, it fills.
"""

from __future__ import annotations

import logging
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS, cut
from .tokens import Encoder, tokenizer_path

LENGTH = 2048
#: Fillings that the search looks at, unless the caller says otherwise: some seconds.
STEPS = 200_000


def pieces_of(total: int, length: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be short of ``length``."""
    first = (total - 1) % length + 1
    return [(0, first)] + [(s, length) for s in range(first, total, length)]


def fillings(lengths: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of ``room``, largest pieces first; None for each dominated one.
    ``lengths`` is ascending, and ``counts`` says how many are left of each, whenever one is asked for."""

    def dominated(chosen: list[int], waste: int) -> bool:
        if not waste:
            return False
        used = Counter(chosen)
        for x in {*chosen, 0, *(a + b for a, b in zip(chosen, chosen[1:], strict=False))}:
            k = bisect_right(lengths, x + waste) - 1
            if k >= 0 and lengths[k] > x and counts[lengths[k]] > used[lengths[k]]:
                return True
        return False

    chosen: list[int] = []
    left, open_ = room, [bisect_right(lengths, room) - 1]  # at each depth, the next length to try
    grown = True  # whether the filling has just grown: then it ends here if nothing can be added
    while open_:
        k = open_[-1]
        while k >= 0 and counts[lengths[k]] <= chosen.count(lengths[k]):
            k -= 1
        if k >= 0:
            open_[-1] = k - 1
            chosen.append(lengths[k])
            left -= lengths[k]
            open_.append(min(k, bisect_right(lengths, left) - 1))
            grown = True
            continue
        if grown:
            yield None if dominated(chosen, left) else tuple(chosen)
        grown = False
        open_.pop()
        if chosen:
            left += chosen.pop()


def best_fit(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: the incumbent. Each sequence starts with the
    largest piece left and takes the largest that fits, again and again."""
    counts = dict(histogram)
    lengths = sorted(counts)
    plan = []
    while lengths:
        filling, left, top = [], length, len(lengths) - 1
        used: dict[int, int] = {}
        while (k := min(top, bisect_right(lengths, left) - 1)) >= 0:
            x = lengths[k]
            if counts[x] > used.get(x, 0):
                filling.append(x)
                used[x] = used.get(x, 0) + 1
                left -= x
                top = k
            else:
                top = k - 1
        times = min(counts[x] // n for x, n in used.items())
        plan.append((tuple(filling), times))
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        lengths = sorted(counts)
    return plan


@dataclass
class Node:
    """A state of the search: its largest piece, the fillings not yet tried, what is left to pack, the
    sequences used, and the filling in use and how often.

    There are about as many at once as there are lengths, so a node keeps the lengths that it has, and
    no counts: those of all pieces left are the same each time that the search comes back to it."""

    top: int
    options: Iterator[tuple[int, ...] | None]
    remaining: int
    size: int
    filling: tuple[int, ...] = ()
    times: int = 0
    in_use: bool = False


def search(histogram: dict[int, int], length: int = LENGTH, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """``(filling, times)``: the plan with the fewest sequences that the search finds, and whether
    it ended by itself, in at most ``steps`` steps."""
    histogram = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= length for x in histogram):
        raise ValueError("pieces must be from 1 token to the sequence length")
    best = best_fit(histogram, length)
    best_size = sum(t for _, t in best)
    total = sum(x * n for x, n in histogram.items())
    bound = max(-(-total // length), sum(n for x, n in histogram.items() if 2 * x > length))
    counts = dict(histogram)
    plan: list[tuple[tuple[int, ...], int]] = []
    stack: list[Node] = []
    # A filling is closed below a node that uses it: plans that use it more often were looked at before.
    closed: set[tuple[int, ...]] = set()

    def open_node(remaining: int, size: int) -> None:
        lengths = sorted(x for x, n in counts.items() if n > 0)
        top = lengths[-1] if counts[lengths[-1]] > 1 else lengths.pop()
        stack.append(Node(top, fillings(array("q", lengths), counts, length - top), remaining, size))

    if best_size > bound:
        open_node(total, 0)
    while stack and best_size > bound:
        node = stack[-1]
        if node.in_use:
            for x in node.filling:
                counts[x] += node.times
            closed.remove(plan.pop()[0])
            node.in_use = False
        if not steps:
            return best, False
        steps -= 1
        if node.times > 1:
            node.times -= 1
        else:
            counts[node.top] -= 1  # it begins the sequence that is filled
            option = next(node.options, "end")
            counts[node.top] += 1
            if option == "end":
                stack.pop()
                continue
            filling = (node.top, *option) if option is not None else None
            if filling is None or filling in closed:
                node.times = 0
                continue
            node.filling, node.times = filling, min(counts[x] // n for x, n in Counter(filling).items())
        after, used = node.remaining - node.times * sum(node.filling), node.size + node.times
        if used + -(-after // length) >= best_size:
            continue
        for x in node.filling:
            counts[x] -= node.times
        plan.append((node.filling, node.times))
        closed.add(node.filling)
        node.in_use = True
        if not after:
            best, best_size = list(plan), used
            continue
        open_node(after, used)
    return best, True


def solve(histogram: dict[int, int], length: int = LENGTH, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """The plan that ``search`` finds; whether it is proved to be the best is logged."""
    plan, ended = search(histogram, length, steps)
    logging.getLogger(__name__).info("packing: %d sequences, %s", sum(t for _, t in plan), "the fewest possible" if ended else f"the best of {steps} steps")
    return plan


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: one row per piece."""

    def run(batches):
        encode = Encoder.get(tokenizer).ids
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for b in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                keys, columns = [], [[] for _ in range(5)]
                for row, text in enumerate(b.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    for piece, (start, n) in enumerate(pieces_of(len(ids) // 4, length)):
                        part = ids[4 * start : 4 * (start + n)]
                        keys.append(row)
                        for c, v in zip(columns, (piece, start, n, zlib.crc32(part), part if keep_ids else None), strict=True):
                            c.append(v)
                arrays = [b.column(0).take(pa.array(keys, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[4], pa.binary())] * keep_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, steps: int = STEPS) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids])``, one row per
    piece: pieces of a sequence lie side by side from offset 0, in at most ``length`` tokens.

    A null or empty text is a document of the end id alone. Repeated rows, and rows that
    share an id or have none, are documents of their own; an empty table has no pieces. ``steps``
    limits the search for a plan, not what is packed. With ``keep_ids`` each piece has
    its ids, as little-endian unsigned 32-bit integers."""
    rows = cut(tokenized(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), end_id, length, id_col, text_col, keep_ids))
    full = rows.where(F.col("length") == length)
    part = rows.where(F.col("length") < length)
    histogram = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}
    plan = solve(histogram, length, steps)
    # Ranks within a length, counted by task that wrote the rows first: a common length spreads
    # over as many groups as there are tasks, whatever the rows are.
    salted = part.withColumns({"salt": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("at"))
    ranked = salted.join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + within - 1)
    slots, used, sequences = [], {}, 0
    for filling, times in plan:
        offset = 0
        for x in filling:
            first = used.get(x, 0)
            slots.append((x, first, first + times, sequences, offset))
            used[x] = first + times
            offset += x
        sequences += times
    by: dict[int, list] = {}
    for x, first, last, sequence, offset in slots:
        by.setdefault(x, []).append((first, last, sequence, offset))
    # One row per length, its ranges in order: of bounded size, as the plan is.
    table = docs.sparkSession.createDataFrame([(x, [r[1] for r in rs], [r[0] for r in rs], [r[2] for r in rs], [r[3] for r in rs]) for x, rs in by.items()], "length long, lasts array<long>, firsts array<long>, sequences array<long>, offsets array<int>")
    which = F.size(F.filter("lasts", lambda e: e <= F.col("rank"))) + 1
    extra = ["ids"] * keep_ids
    placed = ranked.join(table, "length").withColumn("k", which).select("id", "piece", "start", "length", "ids_crc32", (F.element_at("sequences", F.col("k")) + F.col("rank") - F.element_at("firsts", F.col("k"))).alias("sequence_id"), F.element_at("offsets", F.col("k")).cast("long").alias("offset"), *extra)
    alone = full.select("id", "piece", "start", "length", "ids_crc32", (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *extra)
    return placed.union(alone).withColumnRenamed("id", id_col)
