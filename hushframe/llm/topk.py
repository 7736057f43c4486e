"""Exact top-k inner-product search with MaxScore.

A dimension's posting list holds a block's candidates in falling order of their component
there. A query's terms are its components. Relative to the least that a term adds to any
candidate of the block, each adds a *gain* of zero or more, the greatest of which is the term's
score bound. Per query and block, with terms in falling order of bound:

* the first block of a shard sets a threshold: the k-th best full score of candidates at the
  heads of the largest terms' lists;
* terms are *essential* from the top until the bounds of all the others sum to less than a
  candidate needs to enter the query's top k. What the others leave over is dealt to the
  essential terms as cuts, and their lists are traversed down to the cut: a candidate that is met
  in none of them can't enter, nor can one whose gains met and cuts sum to less than the need.
  Of several splits the one of fewest postings is taken;
* where such heads hold most of all postings (components spread evenly on both sides of zero),
  every candidate is met, and the lists are read term by term from the top;
* what is met is probed, a few terms at a time, while it is still *competitive*: while the score
  so far and a bound of the other terms reach the threshold. That bound is the smaller of their
  score bounds' sum and the product of the lengths of what is left of query and candidate.

Queries are dealt into groups and candidates into shards, both of bounded size; each pair of
a group and a shard is a stretch of one sorted partition, its queries first, so that any
number of queries against all rows is one job of bounded memory. Every pair keeps k results
per query, and these are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a group's queries, about, and candidates of a shard.
GROUP_BYTES, SHARD = 32 << 20, 1 << 16
#: Candidates bounded together, and their components, at most (of two candidates at least).
BLOCK, BLOCK_VALUES = 8192, 1 << 20
#: Terms probed at once; largest terms whose heads set the first threshold; splits compared;
#: places of a list by which the length of a head is told.
STEP, STARTS, SPLITS, LEVELS = 8, 8, 8, 33
#: Heads of more than this share of all postings are not traversed.
MOST_HEADS = 0.25
#: Below these, sums of products of whole numbers are exact as doubles, and as 64-bit integers.
DOUBLES, LONGS = float(1 << 53), float(1 << 62)


def quantized(vector, scale: int = 1024):
    """The vector as whole numbers, floor(scale * x), held as doubles; null if it or a component
    is null, or is not finite (also when scaled)."""
    x = F.transform(vector.cast("array<double>"), lambda v: v * F.lit(float(scale)))
    bad = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(x, lambda v: F.when(F.abs(v) < F.lit(DOUBLES), F.floor(v).cast("double")).otherwise(v)))


def matrix(lists: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows of one length, short ones filled up with zeros."""
    out = np.zeros((len(lists), width))
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact: doubles, 64-bit integers, or
    Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if 8 * most < DOUBLES:  # so that sums of bounds are exact, too
        return a, b
    if most < LONGS:
        return a.astype(np.int64), b.astype(np.int64)
    return tuple(np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b))


class Best:
    """The k best (score, id) of a query: higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.need = k, None
        self.scores, self.ids = [], []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            some = scores >= least
            scores, ids = scores[some], ids[some]
            some = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[some], ids[some]
        both = sorted([*zip((-x for x in self.scores), self.ids, strict=True), *zip((-int(s) for s in scores), ids.tolist(), strict=True)])[: self.k]
        self.scores, self.ids = [-s for s, _ in both], [i for _, i in both]
        if len(self.ids) == self.k:
            self.need = self.scores[-1]


class Block:
    """Candidates, their components by dimension, and a posting list per dimension: candidates
    by rising component (read from either end), and the components in that order.

    Values that are not doubles have no lists: their scores are not sure to fit the bounds' type."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(values.T)
        self.lists = None
        if values.dtype == np.float64:
            self.lists = self.columns.argsort(1, kind="stable")
            self.ranked = np.take_along_axis(self.columns, self.lists, 1)
            self.low, self.high = self.ranked[:, 0], self.ranked[:, -1]
            self.levels = self.ranked[:, np.linspace(0, len(ids) - 1, LEVELS).astype(int)]
            self.squares = (self.columns**2).sum(0)


class Terms:
    """A query's terms over a block, in falling order of bound: ``bound`` (of gains), ``rest`` (the
    bounds of the terms from i on, summed), ``base`` (what all terms add at least)."""

    def __init__(self, w: np.ndarray, block: Block):
        ends = w * block.low, w * block.high
        least, gain = np.minimum(*ends), np.abs(ends[1] - ends[0])
        self.order = np.argsort(-gain, kind="stable")
        self.w, self.least, self.bound = w[self.order], least[self.order], gain[self.order]
        self.rest = np.append(np.cumsum(self.bound[::-1])[::-1], 0)
        self.squares = np.append(np.cumsum((self.w**2)[::-1])[::-1], 0)
        self.base = least.sum()

    def threshold(self, k: int, query_id: int, block: Block) -> tuple[float | None, int]:
        """The k-th best score among heads of the largest terms, and the postings read for it; no
        threshold where those are fewer than k."""
        heads = [block.lists[d, -k - 1 :] if w > 0 else block.lists[d, : k + 1] for d, w in zip(self.order[:STARTS], self.w, strict=False)]
        some = np.unique(np.concatenate(heads)) if heads else np.zeros(0, int)
        some = some[block.ids[some] != query_id]
        if len(some) < k:
            return None, 0
        scores = self.w @ block.columns[self.order[:, None], some]
        return np.partition(scores, len(scores) - k)[len(scores) - k], len(some) * len(self.w)

    def split(self, need: float, block: Block) -> tuple[np.ndarray, float]:
        """Cuts of the essential terms, from the first on, and about how many postings lie above;
        without any cuts if there is no such split. ``need`` is the gain that is needed."""
        fits = np.flatnonzero((self.rest < need) & (self.rest < self.rest[0]))
        best, fewest = np.zeros(0), np.inf
        for e in np.unique(fits[np.linspace(0, len(fits) - 1, SPLITS).astype(int)]) if len(fits) else ():
            # Whole numbers below the share, as gains are whole: a miss by rounding can't count.
            cuts = np.floor((need - self.rest[e]) / (self.rest[0] - self.rest[e]) * self.bound[:e])
            above = self.w[:e, None] * block.levels[self.order[:e]] - self.least[:e, None] >= cuts[:, None]
            if (postings := above.mean(1).sum() * len(block.ids)) < fewest:
                best, fewest = cuts, postings
        return best, fewest

    def met(self, cuts: np.ndarray, need: float, block: Block) -> tuple[np.ndarray, int]:
        """Candidates met above the cuts that can still have ``need``, and the postings read."""
        most = np.full(len(block.ids), cuts.sum() + self.rest[len(cuts)])
        seen, read = np.zeros(len(block.ids), bool), 0
        for d, w, least, cut in zip(self.order, self.w, self.least, cuts, strict=False):
            if w > 0:
                head = slice(np.searchsorted(block.ranked[d], (cut + least) / w, "left"), None)
            elif w < 0:
                head = slice(None, np.searchsorted(block.ranked[d], (cut + least) / w, "right"))
            else:
                head = slice(None)
            at = block.lists[d, head]
            most[at] += w * block.ranked[d, head] - least - cut
            seen[at] = True
            read += len(at)
        return seen & (most >= need), read


def search(best: Best, query_id: int, w: np.ndarray, block: Block) -> int:
    """MaxScore for a query over one block of candidates; the number of postings read."""
    live = block.ids != query_id
    if block.lists is None:
        best.add((w @ block.columns)[live], block.ids[live])
        return block.columns.size
    terms, need, read = Terms(w, block), best.need, 0
    if need is None:
        need, read = terms.threshold(best.k, query_id, block)
    if need is not None:
        if terms.rest[0] + terms.base < need:
            return read
        cuts, postings = terms.split(need - terms.base, block)
        if postings < MOST_HEADS * block.columns.size:
            found, more = terms.met(cuts, need - terms.base, block)
            live, read = live & found, read + more
    mine = np.flatnonzero(live)
    score, left, least = np.zeros(len(mine)), block.squares[mine], np.cumsum(terms.least)
    for at in range(0, len(w), STEP):
        some, end = slice(at, at + STEP), min(at + STEP, len(w))
        dims = terms.order[some]
        part = block.columns[dims] if len(mine) == len(block.ids) else block.columns[dims[:, None], mine]
        score, read = score + terms.w[some] @ part, read + part.size
        if need is not None:
            left = left - np.einsum("ij,ij->j", part, part)
            lengths = np.sqrt(np.maximum(left, 0) * terms.squares[end]) * (1 + 1e-9) + 1
            keep = score + np.minimum(lengths, terms.rest[end] + terms.base - least[end - 1]) >= need
            if not keep.all():
                mine, score, left = mine[keep], score[keep], left[keep]
            if not len(mine):
                return read
    if len(mine):
        best.add(score, block.ids[mine])
    return read


def search_shards(batches, k: int):
    """Results of each stretch of rows ``(group, shard, asks, id, v)``: queries come first, then
    the candidates, a block at a time."""
    pair, queries, found, waiting, held = None, [], [], [], 0

    def run() -> None:
        nonlocal waiting, held
        if waiting and queries:
            width = max(len(v) for _, v in queries + waiting)
            values = matrix([v for _, v in waiting], width)
            asked, values = exact(matrix([v for _, v in queries], width), values)
            block = Block(np.array([i for i, _ in waiting], np.int64), values)
            for (query_id, _), w, best in zip(queries, asked, found, strict=True):
                search(best, query_id, w, block)
        waiting, held = [], 0

    def results() -> pa.RecordBatch:
        rows = [(q, i, min(max(s, -(1 << 63)), (1 << 63) - 1), str(s)) for (q, _), best in zip(queries, found, strict=True) for i, s in zip(best.ids, best.scores, strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["query_id", "id", "score", "whole"])

    for b in batches:
        groups, shards, asks, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        lists, flat = b.column(4), b.column(4).values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        for row in range(b.num_rows):
            if (groups[row], shards[row]) != pair:
                run()
                if queries:
                    yield results()
                pair, queries, found = (groups[row], shards[row]), [], []
            one = (int(ids[row]), flat[ends[row] : ends[row + 1]].copy())
            if asks[row]:
                queries.append(one)
                found.append(Best(k))
            else:
                waiting.append(one)
                held = max(held, len(one[1]))
                if len(waiting) == BLOCK or len(waiting) * held > BLOCK_VALUES:
                    run()
    run()
    if queries:
        yield results()


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, group_bytes: int = GROUP_BYTES, shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` best candidates of each query, ties to the
    smaller id; ``is_query`` is a condition on the rows.

    Candidates are all rows but those with the query's id. Vectors that are null or hold null
    or non-finite components, and rows with a null id, take no part. Shorter vectors count as
    filled up with zeros, empty ones have score 0. A candidate row that is repeated is as many
    candidates; a query id that is repeated asks once, with the smallest of its vectors. Order
    is exact for all finite values; a score beyond 64 bits is returned as the largest (smallest)
    64-bit number. An empty table, or one without queries, gives an empty result."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    groups = max(1, -(-size["asks"] * 8 * size["width"] // group_bytes))
    # At least a shard for each core, unless it would be less than a block.
    shards = max(1, -(-size["n"] // shard), min(vectors.sparkSession.sparkContext.defaultParallelism, size["n"] // BLOCK))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    group, spread = F.pmod(F.xxhash64("id"), F.lit(groups)), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(group.cast("int").alias("group"), "id", "v").select("group", spread(shards).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    # Rows alike are dealt by their place, so that copies of one vector spread over the shards.
    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    others = rows.select(place.alias("shard"), "id", "v").select(spread(groups).alias("group"), "shard", F.lit(False).alias("asks"), "id", "v")
    dealt = asked.unionByName(others).repartition("group", "shard").sortWithinPartitions("group", "shard", F.desc("asks"))
    found = dealt.mapInArrow(lambda batches: search_shards(batches, k), "query_id long, id long, score long, whole string")
    # Scores beyond 64 bits are told apart by their whole text: longer numbers are larger.
    beyond = F.when(F.abs("score") >= F.lit((1 << 63) - 1), F.when(F.col("score") > 0, 1).otherwise(-1) * F.length("whole"))
    digits = F.when(beyond.isNull(), "").when(F.col("score") > 0, F.col("whole")).otherwise(F.translate("whole", "0123456789", "9876543210"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce(beyond, F.lit(0))), F.desc(digits), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
