"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, lower-cased, and the words it repeats as terms of
their own, hashed to 2**18 buckets. The model
adds a weight per term and, for each pair of terms in the text, the inner product of their
factors, so that a pair (an insult and a mention of a group) can weigh more, or less, than
its parts:

    raw = w0 + sum_i w_i + 1/2 sum_f [(sum_i v_if)^2 - sum_i v_if^2]

It is fitted to log loss by AdaGrad on a bounded sample of labelled rows. Every term that
two of them hold has a weight and factors. None is left out for being neutral by itself, as
it may count in a pair; but the less its share among toxic and other texts differs for
chance, the more evidence its weight needs (an L2 penalty by term). Factors are penalized by
the term's frequency. The raw score is calibrated by a logistic fit on scores of rows
by fits that have not seen them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, cut, per_text, ranges, smallest

BUCKETS = 1 << 18
WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows learned from, at most: those with the smallest hashed id.
MOST_ROWS = 12_000
#: Labelled rows that must hold a term for it to have a weight: one tells nothing of others.
LEAST_TEXTS = 2
FACTORS, EPOCHS, STEPS, BATCH, RATE, RATE_FACTORS, INIT = 4, 20, 500, 256, 0.1, 0.03, 0.02
#: The penalty of a weight is PENALTY at a z score of USUAL_Z, falls with its fourth power, and
#: stays in the limits given. That of factors grows with the number of rows that hold the term.
PENALTY, USUAL_Z, LIMITS = 10.0, 3.5, (0.3, 300.0)
PENALTY_FACTORS, PENALTY_ROW = 100.0, 0.02
#: Parts of the rows, each scored by a fit on the others, to calibrate on; precision of the prior there.
FOLDS, PRIOR = 3, 0.1
THRESHOLD = 0.7


def words(text: str) -> set[str]:
    """The distinct words of a text, and once more, marked, those that it repeats."""
    found = WORDS.findall(text.lower())
    distinct = set(found)
    if len(distinct) < len(found):
        distinct |= {w + "#" for w, n in Counter(found).items() if n > 1}
    return distinct


def terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a text, in order."""
    return np.array(sorted({zlib.crc32(w.encode()) % BUCKETS for w in words(text)}), np.int64)


@dataclass
class Model:
    index: dict[int, int]  # bucket to row of w and v
    w0: float
    w: np.ndarray
    v: np.ndarray
    scale: float
    shift: float

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return raw(self.w0, self.w, self.v, rows)

    def score(self, texts: list[str]) -> np.ndarray:
        hashed = self.word_rows
        rows = []
        for t in texts:
            found = {hashed(w) for w in words(t)}
            found.discard(-1)
            rows.append(np.array(sorted(found), np.int64))
        return 1 / (1 + np.exp(-(self.scale * self.raw(rows) + self.shift)))

    def word_rows(self, word: str) -> int:
        return self.index.get(zlib.crc32(word.encode()) % BUCKETS, -1)


def raw(w0: float, w: np.ndarray, v: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    counts = np.array([len(r) for r in rows], np.int64)
    out = np.full(len(rows), w0)
    some = np.flatnonzero(counts)
    if len(some):
        flat, starts = np.concatenate([rows[i] for i in some]), ranges(counts[some])[:-1]
        s = np.add.reduceat(v[flat], starts, axis=0)
        q = np.add.reduceat(v[flat] ** 2, starts, axis=0)
        out[some] += np.add.reduceat(w[flat], starts) + 0.5 * (s * s - q).sum(1)
    return out


def fit(rows: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Model | None:
    """A model from hashed terms and labels (0 or 1); None if a label is missing."""
    if len(rows) == 0 or toxic.min() == toxic.max():
        return None
    y = toxic.astype(float)
    flat, bounds = np.concatenate([*rows, np.zeros(0, np.int64)]), ranges(np.array([len(r) for r in rows]))
    buckets, at, total = np.unique(flat, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(total >= LEAST_TEXTS)
    place = np.full(len(buckets), -1)
    place[chosen] = np.arange(len(chosen))
    at = place[at]
    short = [part[part >= 0] for part in (at[bounds[i] : bounds[i + 1]] for i in range(len(rows)))]
    m = max(1, len(chosen))
    # Calibration: a logistic fit of the label to raw scores, each by a fit on the other folds.
    fold = np.random.default_rng(seed).permutation(len(rows)) % FOLDS
    x = np.zeros(len(rows))
    for k in range(FOLDS):
        seen, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(out) and len(seen) and y[seen].min() < y[seen].max():
            x[out] = raw(*descend([short[i] for i in seen], y[seen], m, seed), [short[i] for i in out])
    a, b = calibrate(x, y)
    return Model({int(k): i for i, k in enumerate(buckets[chosen])}, *descend(short, y, m, seed), a, b)


def descend(rows: list[np.ndarray], y: np.ndarray, m: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """``w0, w, v`` of ``m`` terms by AdaGrad on log loss with penalties."""
    share = y.mean()
    flat, which = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    total = np.bincount(flat, minlength=m).astype(float)
    z = (np.bincount(flat, y[which], m) - total * share) / np.sqrt((total + 1) * share * (1 - share))
    # Penalties come in parts, one each time a row with the term is seen.
    each = np.maximum(total, 1)
    hold = np.clip(PENALTY * (USUAL_Z / np.maximum(np.abs(z), 1e-3)) ** 4, *LIMITS) / each
    hold_v = (PENALTY_ROW * total + PENALTY_FACTORS) / each

    # Rows are dealt into batches once; each epoch takes the batches in another order.
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    batches = [Batch([rows[i] for i in part], y[part]) for part in (order[k : k + BATCH] for k in range(0, len(order), BATCH))]
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, INIT, (m, FACTORS))
    g0, gw, gv = 1.0, np.ones(m), np.ones((m, FACTORS))
    for _ in range(max(EPOCHS, STEPS * BATCH // len(rows))):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            used, mine, factors = b.used, w[b.used], v[b.used]
            sums = np.stack([b.sum(f) for f in factors.T], 1)
            x = w0 + b.sum(mine - 0.5 * (factors**2).sum(1)) + 0.5 * (sums**2).sum(1)
            error = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - b.y
            d0 = error.sum()
            g0 += d0 * d0
            w0 -= RATE * d0 / np.sqrt(g0)
            pull = b.spread(error)
            with_others = np.stack([b.spread(error * sums[:, f]) for f in range(FACTORS)], 1)
            dw = pull + hold[used] * b.seen * mine
            dv = with_others + (hold_v[used] * b.seen - pull)[:, None] * factors
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE_FACTORS * dv / np.sqrt(gv[used])
    return w0, w, v


class Batch:
    """Rows of terms with labels: their distinct terms, and sums over rows and over terms."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.y, counts = y, np.array([len(r) for r in rows])
        self.used, self.at, self.seen = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        self.of, self.some = np.repeat(np.arange(len(rows)), counts), np.flatnonzero(counts)
        self.starts = ranges(counts[self.some])[:-1]

    def sum(self, values: np.ndarray) -> np.ndarray:
        """Of each row, the sum of its terms' values."""
        out = np.zeros(len(self.y))
        if len(self.some):
            out[self.some] = np.add.reduceat(values[self.at], self.starts)
        return out

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Of each term, the sum of its rows' values."""
        return np.bincount(self.at, values[self.of], len(self.used))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of raw scores, by Newton steps with a small prior."""
    x = np.clip(x, -30, 30)
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * x + b)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + PRIOR * (a - 1), (p - y).sum() + PRIOR * b])
        h = np.array([[(s * x * x).sum() + PRIOR, (s * x).sum()], [(s * x).sum(), s.sum() + PRIOR]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model | None:
    """A model from the rows of ``docs`` that ``labels`` marks, at most ``most_rows`` of them.
    Rows without a label are left out; None if there are none, or of one label only."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    ids = docs.select(F.col(id_col).alias("id")).join(marked, "id")
    chosen = smallest(cut(ids.distinct()), "id", most_rows)
    # One row per id, however often it is repeated: the greatest text.
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.max("text").alias("text"))
    hashed = per_text(lambda texts: pa.array([terms(t).astype(np.int32) for t in texts.to_pylist()], pa.list_(pa.int32())), "array<int>")
    table = found.select("id", "y", hashed(F.col("text")).alias("terms")).toArrow()
    if not table.num_rows:
        return None
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    lists = table.column("terms").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return fit([flat[at[i] : at[i + 1]].astype(np.int64) for i in order], table.column("y").to_numpy()[order])


def scorer(model: Model | None, spark):
    """An Arrow function from a text to its score, 0 to 1 (0.0 without a model)."""
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array(m.score(texts.to_pylist()) if m else np.zeros(len(texts)))

    return per_text(run, "double")


def held_out(id_col: str = "doc_id", buckets: int = 3, bucket: int = 1):
    return F.coalesce(bucket_of(F.col(id_col), buckets) == bucket, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` per row of ``docs``.

    Learns only from rows that are not held out (crc32 of the id's text, modulo 3, is 1; a
    null id is not held out). Null and empty texts are scored like a text without terms.
    Repeated rows come back each; a document marked twice counts as toxic if it once is."""
    out = held_out(id_col)
    model = train(docs.where(~out), labels, id_col, text_col, label_col, most_rows)
    scored = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), scorer(model, docs.sparkSession)(F.col(text_col)).alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
