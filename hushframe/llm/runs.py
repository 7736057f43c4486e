"""Periodic runs: stretches of words that repeat themselves at least four times over.

A run has a smallest period ``q`` (words ``q`` apart are the same) and at least
``max(6, 4 * q)`` words, and no word beside it goes on with the period. The words of a text are
read once, in order; each one's earlier occurrences lengthen the diagonals (lags) that are
alive, and a diagonal that a word does not lengthen ends there and, if it is long enough, is
a run at once. Two facts keep the diagonals few, whatever the text:

* Lags fall into classes ``low <= q < 1.5 * low``. A run of such a lag matches for at least ``3 * low``
  words, so a word counts as occurring earlier only together with its context, the ``3 * low``
  words that begin with it.
* Of a context's earlier occurrences only the latest can lie a run's period back. If one lay
  nearer, at ``r < q``, the context would have the periods ``q`` and ``r``, and with ``q + r < 3 * low``
  words also their common divisor, so that ``q`` would not be the smallest period.

So a word meets at most one diagonal per class; a text of one word a million times over takes
as long as any other of its length, up to a logarithm. Contexts are compared exactly: equal ones
get equal numbers, made by doubling their length, and those that occur once are left behind
at each step, which in prose is nearly all of them after three words.

Null and empty texts have no runs and an empty collapsed text. Each row is looked at by itself, so
repeated rows give repeated results and an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import per_text

#: Words looked at together; a longer text is looked at alone.
TOGETHER = 1 << 17
KIND = "struct<n_words long, runs array<struct<start long, length long, period long>>, collapsed string>"


def classes(most: int) -> Iterator[tuple[int, int]]:
    """``(low, end)``: lags from ``low`` up to, not including, ``end``, as far as ``most``."""
    low = 1
    while low <= most:
        end = -(-3 * low // 2)
        yield low, end
        low = end


def alike(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at``, ordered by their pair of numbers and then by place, and which of them have
    the pair of the one before."""
    pair = (first << 32) | second
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    same = np.zeros(len(at), bool)
    same[1:] = pair[1:] == pair[:-1]
    return at[order], same


def occurrences(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, lag, context)``, by place: how far back each word last occurred with the same
    ``context`` words beginning there, for lags of the class of that context and up to ``most``."""
    at, number, size = np.arange(len(ids)), ids.astype(np.int64), 1
    found = []
    for low, end in classes(most):
        context = 3 * low
        while 2 * size <= context and len(at):
            at = at[at + size < len(ids)]
            at = at[(number[at] >= 0) & (number[at + size] >= 0)]
            at, same = alike(at, number[at], number[at + size])
            more = same.copy()
            more[:-1] |= same[1:]
            number = np.full(len(ids), -1, np.int64)
            number[at] = np.where(more, np.cumsum(~same), -1)
            at, size = np.sort(at[more]), 2 * size
        rest = context - size
        here = at[at + rest < len(ids)]
        here = here[number[here + rest] >= 0]
        if not len(here):
            if not len(at):
                break
            continue
        here, same = alike(here, number[here], number[here + rest])
        lag = np.zeros(len(here), np.int64)
        lag[1:] = np.where(same[1:], here[1:] - here[:-1], 0)
        fits = (lag >= low) & (lag < end)
        found.append((here[fits], lag[fits], np.full(fits.sum(), context)))
    if not found:
        return (np.empty(0, np.int64),) * 3
    place, lag, context = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((lag, place))
    return place[order], lag[order], context[order]


def runs(ids: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs among words ``ids`` with periods up to ``most``."""
    alive: dict[int, tuple[int, int]] = {}  # lag: where its matches begin, and the words of its context
    longer: dict[int, tuple[int, int]] = {}
    now = -1

    def ended(gone, before: int) -> Iterator[tuple[int, int, int]]:
        for lag in gone:
            begin, context = alive[lag]
            matches = before - begin + context
            if matches >= max(6 - lag, 3 * lag):
                yield begin - lag, matches + lag, lag

    for place, lag, context in zip(*(x.tolist() for x in occurrences(ids, most)), strict=True):
        if place != now:
            yield from ended(alive.keys() - longer.keys(), now - 1)
            alive, longer = longer, {}
            if place != now + 1:
                yield from ended(alive, now)
                alive = {}
            now = place
        longer[lag] = alive.get(lag, (place, context))
    yield from ended(alive.keys() - longer.keys(), now - 1)
    alive = longer
    yield from ended(alive, now)


def looked_at(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period. The texts lie side by side; the same word has
    another number in each, so nothing matches across."""
    numbers, starts, made = [], [0], 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64) + made)
        made += len(known)
        starts.append(starts[-1] + len(words))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = list(runs(np.concatenate(numbers), max(map(len, texts)) // 4))
    for of, (start, length, period) in zip(np.searchsorted(starts, [r[0] for r in found], "right") - 1, found, strict=True):
        out[of].append((start - starts[of], length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words but for those that a run has after its first period."""
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
    return b" ".join(words).decode()


def together(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for words in texts:
        if group and size + len(words) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def periodic(text: Column) -> Column:
    """``(n_words, runs, collapsed)`` of a text: its periodic runs, by start and period, and its words
    joined by single spaces, without what the runs repeat. A null text is an empty one."""

    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for group in together([t.split() for t in texts.cast(pa.binary()).to_pylist()]):
            for words, found in zip(group, looked_at(group), strict=True):
                rows.append({"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], "collapsed": collapsed(words, found)})
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())]))

    return per_text(find, KIND)(text)


def planted(doc_id: Column, text: Column) -> Column:
    """The text's words; those of one id in ten (by its crc32) repeat from some word on. A null id
    has none planted."""

    def plant(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for key, whole in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
            h, words = zlib.crc32(str(key).encode()), (whole or b"").split()
            if key is not None and h % 10 == 0 and words:
                n, g = len(words), h // 10
                a = g % n
                period = words[a : a + 1 + (n - a) // (3 + g % 8)]
                words = words[:a] + (period * -(-(n - a) // len(period)))[: n - a]
            out.append(b" ".join(words).decode())
        return pa.array(out, pa.string())

    plant.__annotations__ = {"ids": pa.Array, "texts": pa.Array, "return": pa.Array}
    return arrow_udf(plant, "string")(doc_id, text)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every document; one pass, no shuffle."""
    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.col(doc_id), periodic(text).alias("__seen")).select(doc_id, "__seen.*")


def summed_up(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document, how many runs, the longest one (of several, the one of smallest start, then
    period; null if there is none), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    told = found.withColumn("__best", best)
    return told.select(
        doc_id,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__best.start")).alias("start"),
        F.col("__best.length").alias("length"),
        (-F.col("__best.period")).alias("period"),
        F.expr("(1000 * __best.length) div -__best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same in DuckDB: crc32 bit by bit, all pairs of the same word of a text, their diagonals as
#: islands, and of runs at one place the one of the smallest period.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(unicode(c)::BIGINT, list_transform(range(8), lambda k: -1))))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h FROM documents),
s AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM t),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM s),
u AS MATERIALIZED (SELECT r, n, unnest(w) AS w, unnest(range(n)) AS i FROM d),
m AS (SELECT x.r, x.i, x.i - y.i AS q FROM u x JOIN u y ON x.r = y.r AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM m),
e AS (SELECT r, q, min(i) - q AS start, count(*) + q AS length FROM g GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM e GROUP BY r, start, length),
of AS (SELECT r, count(*) AS n, max({'length': length, 's': -start, 'p': -period}) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS c FROM u ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(of.n, 0) AS n_runs, -b.s AS start, b.length AS length, -b.p AS period, 1000 * b.length // -b.p AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN of USING (r) LEFT JOIN kept USING (r)"""
