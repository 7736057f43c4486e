"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

The codebooks come from Lloyd's rounds over all vectors, in whole numbers, so that the result
is the same on any number of machines. The driver holds the codebooks alone (at most 256 entries
a part) and sends them out with each round; a task keeps one sum per entry and dimension.

Within a task, a round compares two trees, one over a batch's parts and one over the entries.
A pair of nodes has a least and a greatest possible distance, from their boxes; entry nodes that
are farther than another one surely is are left out, and so are entries that are farther than
another one at every corner of the box. Where one entry is left, the whole node is its, by the
sum that the node has ready; where several are left in a leaf, distances in whole numbers decide.

Defined results: rows whose vector is null or empty, or holds null or a non-finite number, take no
part, nor do those of another dimension than the kept row of the smallest id has. Parts differ by
one component at most, the first ones being longer, where the dimension is not a multiple of their
number. Components stop at plus and minus 2**62. Rows of a null id count as the last ones. With
fewer rows than entries the codebook is as long as there are rows. Repeated rows are vectors of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import join_hot, written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components are 1024ths, up to this.
SCALE, MOST = 1024.0, 1 << 62
#: Parts in a leaf.
LEAF = 64


@dataclass
class Tree:
    """A tree of boxes over rows. Node k holds the rows ``order[first[k]:end[k]]``; ``left`` is -1 in a
    leaf, and the right child follows the left one."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    end: np.ndarray
    left: np.ndarray
    total: np.ndarray


def tree(x: np.ndarray, leaf: int) -> Tree:
    """Rows cut in half at the middle of their widest dimension, until ``leaf`` of them are left or
    all are the same."""
    order, nodes, left = np.arange(len(x)), [(0, len(x))], [-1]
    low, high, total = [], [], []
    at = 0
    while at < len(nodes):
        first, end = nodes[at]
        own = x[order[first:end]]
        low.append(own.min(0))
        high.append(own.max(0))
        total.append(own.sum(0))
        width = high[-1] - low[-1]
        if end - first > leaf and width.any():
            middle = (first + end) // 2
            order[first:end] = order[first:end][np.argsort(own[:, int(np.argmax(width))], kind="stable")]
            left[at] = len(nodes)
            nodes += [(first, middle), (middle, end)]
            left += [-1, -1]
        at += 1
    ends = np.array(nodes)
    return Tree(order, np.array(low), np.array(high), ends[:, 0], ends[:, 1], np.array(left), np.array(total))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the nearest entry of ``book`` (of equal ones the first); and each entry's number of
    rows and their sum."""
    codes, n, sums = np.zeros(len(x), np.int64), np.zeros(len(book), np.int64), np.zeros(book.shape, x.dtype)
    kept = np.sort(np.unique(book.astype(str) if book.dtype == object else book, axis=0, return_index=True)[1])
    parts, entries = tree(x, LEAF), tree(book[kept], 1)
    number = kept[entries.order]  # by place in the tree

    def whole(node: int, entry: int) -> None:
        first, end = parts.first[node], parts.end[node]
        codes[parts.order[first:end]] = entry
        n[entry] += end - first
        sums[entry] += parts.total[node]

    work = [(0, np.array([0]))]
    while work:
        node, those = work.pop()
        low, high = parts.low[node], parts.high[node]
        if len(those) > 1:
            apart = np.maximum(np.maximum(entries.low[those] - high, low - entries.high[those]), 0)
            across = np.maximum(entries.high[those] - low, high - entries.low[those])
            those = those[(apart * apart).sum(1) <= (across * across).sum(1).min()]
        inner = entries.left[those] >= 0
        if not inner.any():
            own = np.sort(number[entries.first[those]])
            if len(own) > 1:
                own = not_beaten(low, high, book, own)
            if len(own) == 1:
                whole(node, int(own[0]))
                continue
            if parts.left[node] < 0:
                rows = parts.order[parts.first[node] : parts.end[node]]
                near = book[own]
                best = own[np.argmin((near * near).sum(1) - 2 * (x[rows] @ near.T), axis=1)]
                codes[rows] = best
                np.add.at(n, best, 1)
                np.add.at(sums, best, x[rows])
                continue
            those = those[np.isin(number[entries.first[those]], own)]
        else:
            opened = entries.left[those[inner]]
            those = np.concatenate([those[~inner], opened, opened + 1])
        if parts.left[node] < 0:
            work.append((node, those))
        else:
            work += [(parts.left[node], those), (parts.left[node] + 1, those)]
    return codes, n, sums


def not_beaten(low: np.ndarray, high: np.ndarray, book: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The entries but for those that the one nearest to the box's middle beats wherever in the box.
    By how much it does so is linear in the place, so the box's corners tell."""
    away = 2 * book[own] - (low + high)
    best = own[int(np.argmin((away * away).sum(1)))]
    step = book[own] - book[best]
    lead = (book[own] * book[own]).sum(1) - (book[best] * book[best]).sum() - 2 * np.where(step > 0, step * high, step * low).sum(1)
    return own[~((lead > 0) | ((lead == 0) & (own > best)))]


def matrix(vectors: pa.Array, books: list[np.ndarray]) -> np.ndarray:
    """The vectors as rows of whole numbers: in doubles where even sums of squares are exact in them,
    else in 64 bits, else, where squares could be too large for those, in Python's own."""
    width = sum(b.shape[1] for b in books)
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    most = max([int(max(abs(int(a.min())), abs(int(a.max())))) for a in (x, *books) if a.size], default=0)
    largest = 8 * width * most * most
    return x.astype(np.float64 if largest < 1 << 52 else np.int64 if largest < 1 << 62 else object)


def starts(width: int, parts: int) -> list[int]:
    """Where each part begins, and the end."""
    return [k * (width // parts) + min(k, width % parts) for k in range(parts + 1)]


def assigned(vectors: pa.Array, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its rows, the codebook, and what ``nearest`` tells of them."""
    x = matrix(vectors, books)
    at = starts(x.shape[1], len(books))
    for part, book in enumerate(books):
        own, book = x[:, at[part] : at[part + 1]], book.astype(x.dtype)
        yield own, book, *nearest(own, book)


def round_of(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all ``vectors`` (column ``__x``)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [np.zeros(len(b), object) for b in books], [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            if batch.num_rows:
                for part, (_, _, _, count, own) in enumerate(assigned(batch.column(0), books)):
                    n[part] += count
                    total[part] += own if own.dtype == object else own.astype(np.int64)
        rows = [(part, e, k, int(n[part][e]), str(total[part][e, k])) for part, b in enumerate(books) for e in np.flatnonzero(n[part]).tolist() for k in range(b.shape[1])]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["part", "entry", "k", "n", "total"])

    told = vectors.select("__x").mapInArrow(sums, "part int, entry int, k int, n long, total string")
    told = told.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    after = [b.copy() for b in books]
    for r in told.collect():  # at most one row per entry and component
        after[r["part"]][r["entry"], r["k"]] = int(r["total"]) // r["n"]
    return after


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def whole_numbers(vector: Column) -> Column:
    """The components as 1024ths, rounded down."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * SCALE).cast("long"))))


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, codes, error)`` of every vector, written once, and the codebooks. ``error`` is
    the sum of the parts' squared distances; one beyond 64 bits is given as the largest number of 64 bits."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte")
    x = F.col(vector)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | F.abs(c.cast("double")).isin(float("inf")))
    kept = df.where(x.isNotNull() & (F.size(x) > 0)).where(finite).select(F.col(vec_id), F.col(label), whole_numbers(x).alias("__x"))
    line = [F.col(vec_id).asc_nulls_last()]
    head = kept.orderBy(*line, "__x").select(F.size("__x")).first()
    width = head[0] if head else parts
    kept = kept.where(F.size("__x") == width)
    first = np.array([r["__x"] for r in kept.orderBy(*line, "__x").select("__x").limit(entries).collect()], np.int64).reshape(-1, width)
    at = starts(width, parts)
    books = [first[:, at[k] : at[k + 1]] for k in range(parts)]
    for _ in range(rounds if head else 0):
        books = round_of(kept, books)
    last = books

    def code(vectors: pa.Array) -> pa.Array:
        found = list(assigned(vectors, last)) if len(vectors) else []
        error = sum(((own - book[codes]) ** 2).sum(1) for own, book, codes, _, _ in found)
        codes = np.stack([f[2] for f in found], 1).tolist() if found else []
        return pa.array([{"codes": c, "error": min(int(e), (1 << 63) - 1)} for c, e in zip(codes, error if found else [], strict=True)], pa.struct([("codes", pa.list_(pa.int32())), ("error", pa.int64())]))

    code.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    told = kept.select(vec_id, label, arrow_udf(code, "struct<codes array<int>, error long>").asNondeterministic()("__x").alias("__told"))
    return written(told.select(vec_id, label, "__told.*")), books


def label_errors(found: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """``found`` with ``label_error``, the sum of the errors of all rows of its label; nulls are one label.
    Sums are made before they travel, and a label that many rows have meets them where they are."""
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    keyed = found.withColumn("__label", key)
    sums = keyed.groupBy("__label").agg(F.sum(F.col(error).cast("decimal(38,0)")).alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    most = F.lit((1 << 63) - 1)
    return join_hot(keyed, sums, "__label", "__rows").select(*found.columns, F.least(F.col("__sum"), most.cast("decimal(38,0)")).cast("long").alias("label_error"))


def sql() -> str:
    """The same in DuckDB, with every part against every entry, for the production parameters and
    vectors of one dimension."""
    vectors = """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c, len(embedding) // 4 AS d
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, c[k * d + 1 : (k + 1) * d] AS x FROM v, range(4) AS t(k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, x FROM p WHERE r <= 256)"""
    near = "(SELECT r, p.k, p.x, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) ** 2))::BIGINT, 'e': e}}) AS m FROM p JOIN b{0} b ON p.k = b.k GROUP BY r, p.k, p.x)"
    rounds = [
        f""",
a{n} AS MATERIALIZED {near.format(n)},
m{n} AS (SELECT k, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT k, m.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{n}) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT k, e, coalesce(y, x) AS x FROM b{n} LEFT JOIN (SELECT k, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM m{n} GROUP BY ALL) USING (k, e))"""
        for n in range(ROUNDS)
    ]
    return (
        vectors
        + "".join(rounds)
        + f""",
f AS (SELECT r, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error FROM {near.format(ROUNDS)} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM f JOIN v USING (r)"""
    )


SQL = sql()
