"""Quality rules with an isolation forest on rule statistics.

Fixed rules come first (too few words, too much repetition). The rest is judged by an
isolation forest over statistics that do not depend on a text's length: trees part a sample
at random values of random statistics, and documents that are parted from the others after
few splits are anomalous. The score is 2 ** (-mean path length / the path length expected
in such a sample). Each tree draws its own sample of all labelled rows; the threshold is
calibrated on the scores of all of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, per_text, sorted_ranks, struct_array, written

#: Fixed values of the rules.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
STATS = ["word_len", "symbols", "dup_lines", "repeat", "upper", "digit", "punct", "exclaim", "bars", "distinct"]
PRIOR = 50
#: Words in whose blocks distinct ones are counted: a share over all words falls with a text's length.
BLOCK = 400
TREES, SAMPLE = 200, 256
#: Share of rows labelled bad in each tree's sample: few, so that they are soon alone, but
#: there, so that splits reach as far as their statistics do.
BAD = 0.02
#: Share of labelled good rows that the threshold keeps, at least.
KEEP = 0.995
#: Thresholds that are tried: quantiles of the scores.
TRIES = 400


def repeated_words(words: list[str]) -> int:
    """Words in a 3-word window that occurs twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    m = len(ids)
    if m < 2_000_000:
        code = (w[:-2] * m + w[1:-1]) * m + w[2:]
    else:  # numbers of pairs first, so that codes stay in 64 bits
        code = np.unique(w[:-2] * m + w[1:-1], return_inverse=True)[1].astype(np.int64) * m + w[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= hit
    return int(covered.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """``[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words]`` and ``STATS``."""
    words = WORD.findall(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS[1:-1]))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(STATS)
    digits = sum(map(text.count, "0123456789"))
    punct = sum(map(text.count, ".,;:!?"))
    distinct = sum(len(set(words[at : at + BLOCK])) for at in range(0, n, BLOCK))
    # Counts are taken over n + PRIOR words, so that one odd word in a short text is no extreme.
    m, exclaims, bars = n + PRIOR, text.count("!") + text.count("?"), text.count("|")
    ratios = [chars / n, symbols / m, dup / (len(lines) + 5), repeat / m, sum(map(str.isupper, words)) / m, digits / (chars + 5 * PRIOR), (punct - exclaims) / m, exclaims / m, bars / m, distinct / n]
    return [n, chars, symbols, dup, repeat], ratios


@dataclass
class Forest:
    """Trees as arrays: split statistic (-1 at a leaf), value, children, and path length."""

    stat: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    expected: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                stat = self.stat[node]
                inner = np.flatnonzero(stat >= 0)
                if not len(inner):
                    break
                at = node[inner]
                less = x[inner, stat[inner]] < self.value[at]
                node[inner] = np.where(less, self.left[at], self.right[at])
            total += self.length[node]
        return 2.0 ** (-total / len(self.roots) / self.expected)


def expected_path(n: int) -> float:
    """The mean path length of an unsuccessful search in a random binary tree of ``n``."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def drawn(bad_rows: int, good_rows: int, seed: int = 11, trees: int = TREES, sample: int = SAMPLE, bad: float = BAD) -> list[np.ndarray]:
    """The rows of each tree's sample, by number, where the bad rows come first: good ones and a share
    ``bad`` of the others; of all rows where either kind is missing."""
    rng = np.random.default_rng(seed)
    n = bad_rows + good_rows
    size = min(sample, n)
    few = round(size * bad) if bad_rows and good_rows else 0
    if not few:
        return [rng.choice(n, size, replace=False) for _ in range(trees)]
    k = min(few, bad_rows)
    return [np.concatenate([bad_rows + rng.choice(good_rows, min(size - k, good_rows), replace=False), rng.choice(bad_rows, k, replace=False)]) for _ in range(trees)]


def forest_of(samples: list[np.ndarray], size: int, seed: int = 11) -> Forest:
    """A tree on each of the ``samples``, of ``size`` rows or so."""
    rng = np.random.default_rng(seed)
    most = int(np.ceil(np.log2(max(size, 2))))
    nodes: list[list] = []

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + expected_path(len(rows))])
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth < most and len(rows) > 1 and len(open_):
            k = int(rng.choice(open_))
            at = rng.uniform(low[k], high[k])
            less = rows[:, k] < at
            nodes[me][:4] = [k, at, split(rows[less], depth + 1), split(rows[~less], depth + 1)]
        return me

    roots = [split(rows, 0) for rows in samples]
    columns = list(zip(*nodes, strict=True))
    return Forest(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]), np.array(roots), expected_path(size) or 1.0)


def grow(x: np.ndarray, good: np.ndarray, seed: int = 11, trees: int = TREES, sample: int = SAMPLE, bad: float = BAD) -> Forest:
    """Trees on samples of rows at hand; see ``drawn``."""
    rows = x[np.argsort(good, kind="stable")]
    return forest_of([rows[k] for k in drawn(int((~good).sum()), int(good.sum()), seed, trees, sample, bad)], min(sample, len(x)), seed)


def best(tries: np.ndarray, kept_good: np.ndarray, dropped_bad: np.ndarray, keep: float) -> float:
    """The try of best balanced accuracy among those that keep at least ``keep`` of the good rows."""
    gain = np.where(kept_good >= keep, kept_good + dropped_bad, -1)
    return float(tries[int(np.argmax(gain))]) if gain.max() >= 0 else 1.0


def quantiles(scored: DataFrame, n: int, shares: np.ndarray) -> np.ndarray:
    """Quantiles of ``score`` over all ``n`` rows, between neighbours as numpy has them: only the rows
    next to them come to the driver."""
    at = shares * (n - 1)
    low = np.floor(at).astype(np.int64)
    wanted = np.unique(np.minimum(np.concatenate([low, low + 1]), n - 1)).tolist()
    wanted = scored.sparkSession.createDataFrame([(k,) for k in wanted], "rank long")
    found = sorted_ranks(scored.select("score"), [], ["score"]).join(F.broadcast(wanted), "rank").toArrow().to_pylist()
    of = {r["rank"]: r["score"] for r in found}
    a, b = (np.array([of[min(k, n - 1)] for k in ks.tolist()]) for ks in (low, low + 1))
    return a + (b - a) * (at - low)


def calibrate(scored: DataFrame, bad_rows: int, good_rows: int, keep: float = KEEP) -> float:
    """The threshold of best balanced accuracy among those that keep at least ``keep`` of the
    good rows of ``scored (score, y)``; a document is kept if its score is at most the threshold.
    All rows count: between two tries there is one count for each kind."""
    n = bad_rows + good_rows
    if not bad_rows or not good_rows:
        return float(quantiles(scored, n, np.array([keep]))[0])
    tries = np.unique(quantiles(scored, n, np.linspace(0, 1, TRIES)))

    def run(scores: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(tries, scores.to_numpy(zero_copy_only=False), "left"), pa.int64())

    run.__annotations__ = {"scores": pa.Array, "return": pa.Array}
    above = np.zeros((2, len(tries) + 1))
    for r in scored.groupBy((F.col("y") == 1).cast("int").alias("y"), arrow_udf(run, "bigint")("score").alias("k")).agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist():
        above[r["y"], r["k"]] = r["n"]  # scores above k of the tries
    upto = above.cumsum(1)[:, :-1]
    return best(tries, upto[1] / good_rows, 1 - upto[0] / bad_rows, keep)


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
COUNTS = [f.split()[0] for f in FIELDS.split(", ")]


def measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [measure(t) for t in texts.to_pylist()]
    return np.array([f[0] for f in found], np.int64).reshape(-1, 5), np.array([f[1] for f in found], float).reshape(-1, len(STATS))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", keep: float = KEEP) -> Forest | None:
    """A forest for ``rows (id, x, ok)`` on the labelled ones that pass the fixed rules, with its
    threshold; None without such rows. Of rows of one id, one counts."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    found = rows.join(marked, "id").groupBy("id", "y").agg(F.max(F.struct("x", "ok")).alias("m")).where("m.ok")
    ranked = cut(sorted_ranks(found.select((F.col("y") == 1).cast("int").alias("y"), "id", "m.x"), [], ["y", "id"]))
    count = {r["y"]: r["n"] for r in ranked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad_rows, good_rows = count.get(0, 0), count.get(1, 0)
    if bad_rows + good_rows < 2:
        return None
    samples = drawn(bad_rows, good_rows)
    wanted = rows.sparkSession.createDataFrame([(k,) for k in np.unique(np.concatenate(samples)).tolist()], "rank long")
    at = ranked.join(F.broadcast(wanted), "rank").select("rank", "x").toArrow()
    numbers = at.column("rank").to_numpy()
    order = np.argsort(numbers)
    x, numbers = np.array(at.column("x").to_pylist())[order], numbers[order]
    forest = forest_of([x[np.searchsorted(numbers, k)] for k in samples], len(samples[0]))
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(xs: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(np.array(xs.to_pylist(), float).reshape(-1, len(STATS))))

    run.__annotations__ = {"xs": pa.Array, "return": pa.Array}
    scored = cut(ranked.select("y", arrow_udf(run, "double")("x").alias("score")))
    forest.threshold = calibrate(scored, bad_rows, good_rows, keep)
    return forest


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> Forest | None:
    """``fit`` on all labelled rows of ``docs``."""
    return fit(measures(docs, id_col, text_col).select("id", "m.x", "m.ok"), labels, id_col, label_col, keep)


KINDS = ",".join(f.replace(" ", ":") for f in FIELDS.split(", "))


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, m)``: the counts and statistics of each row, written down so that each text is read once."""

    def run(texts: pa.Array) -> pa.Array:
        counts, ratios = measured(texts)
        return struct_array(**dict(zip(COUNTS, map(pa.array, counts.T), strict=True)), x=pa.array(list(ratios), pa.list_(pa.float64())), ok=pa.array(~failed(counts)))

    return written(docs.select(F.col(id_col).alias("id"), per_text(run, f"struct<{KINDS},x:array<double>,ok:boolean>")(F.col(text_col)).alias("m")))


def failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    anomaly)`` per row of ``docs``.

    A null text has no words; a text without words has statistics 0 and fails the fixed
    rules. Without labelled rows only the fixed rules count. Repeated rows come back each."""
    rows = measures(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows.select("id", "m.x", "m.ok"), labels, id_col, label_col, **options))

    def run(xs: pa.Array, ok: pa.Array) -> pa.Array:
        forest, good = sent.value, ok.to_numpy(zero_copy_only=False).astype(bool)
        anomaly = forest.score(np.array(xs.to_pylist(), float).reshape(-1, len(STATS))) if forest else np.zeros(len(good))
        kept = good & (anomaly <= (forest.threshold if forest else 1.0))
        return struct_array(base_failed=pa.array(~good), kept=pa.array(kept), anomaly=pa.array(anomaly))

    run.__annotations__ = {"xs": pa.Array, "ok": pa.Array, "return": pa.Array}
    told = rows.select("id", "m", arrow_udf(run, "struct<base_failed:boolean,kept:boolean,anomaly:double>")("m.x", "m.ok").alias("t"))
    return told.select(F.col("id").alias(id_col), *[f"m.{c}" for c in COUNTS], "t.*")
