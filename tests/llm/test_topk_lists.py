"""Top-k search over blocks: equal to scoring everything, and the postings it reads."""

import numpy as np
import pytest

from hushframe.llm.topk import Best, Block, search

K = 10


def vectors(kind: str, n: int, width: int, rng) -> np.ndarray:
    if kind == "skewed":  # a few large components, all others small
        x = rng.normal(0, 4, (n, width))
        x[np.arange(n)[:, None], rng.integers(0, width, (n, 3))] = rng.normal(0, 600, (n, 3))
    elif kind == "sparse":
        x = rng.exponential(200, (n, width)) * (rng.random((n, width)) < 0.05)
    elif kind == "even":
        x = rng.normal(0, 128, (n, width))
    elif kind == "ties":
        x = rng.integers(-1, 2, (n, width))
    elif kind == "negative":
        x = -rng.exponential(100, (n, width))
    else:  # rows alike, and a constant dimension
        x = np.repeat(rng.normal(0, 100, (n // 50 + 1, width)), 50, 0)[:n]
        x[:, 0] = 7
    return np.floor(x).astype(float)


def plain(w: np.ndarray, values: np.ndarray, own: int) -> list[tuple[int, int]]:
    scores = (values.astype(np.int64) @ w.astype(np.int64)).tolist()
    return sorted((-s, i) for i, s in enumerate(scores) if i != own)[:K]


def run(values: np.ndarray, block: int, queries: int) -> int:
    """Postings read; the results are compared with a plain search."""
    blocks = [Block(np.arange(a, min(a + block, len(values))), values[a : a + block]) for a in range(0, len(values), block)]
    read = 0
    for q in range(queries):
        best = Best(K)
        read += sum(search(best, q, values[q], b) for b in blocks)
        assert list(zip((-s for s in best.scores), best.ids, strict=True)) == plain(values[q], values, q)
    return read


@pytest.mark.parametrize("kind", ["skewed", "sparse", "even", "ties", "negative", "alike"])
@pytest.mark.parametrize(("n", "width", "block"), [(7, 3, 50), (300, 1, 64), (700, 24, 256), (1000, 64, 1000)])
def test_equals_scoring_everything(kind, n, width, block):
    run(vectors(kind, n, width, np.random.default_rng(n + width)), block, min(n, 25))


@pytest.mark.parametrize(("kind", "share"), [("skewed", 0.1), ("sparse", 0.25), ("even", 0.85)])
def test_postings_read(kind, share):
    values = vectors(kind, 6000, 64, np.random.default_rng(5))
    assert run(values, 2048, 40) < share * 40 * values.size


def test_smallest_is_the_same_with_and_without_a_cut(spark):
    """Of many rows, those whose hashes are smallest, though few of them reach the sort."""
    from pyspark.sql import functions as F

    from hushframe.llm.common import smallest

    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    want = [r["id"] for r in rows.orderBy("h", "id").limit(500).collect()]
    assert [r["id"] for r in smallest(spark.range(20_000), "id", 500).collect()] == want
    assert smallest(spark.range(30), "id", 500).count() == 30 and smallest(spark.range(0), "id", 500).count() == 0
