"""Periodic runs, vector codes and token counts against plain versions, and on odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import common, runs, token_counts, vector_codes
from hushframe.llm import queries as llm
from hushframe.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row int, key string, n long, bytes long, seen int"


def plain_runs(w):
    """By the definition: for every period, the stretches in which words that far apart are the same."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            begin = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            if length >= max(6, 4 * q) and not any(w[start + r : start + length] == w[start : start + length - r] for r in range(1, q)):
                out.add((start, length, q))
            i = max(i, begin + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_texts():
    rng, seen = random.Random(7), 0
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 80))]
            for _ in range(rng.randint(0, 3)):
                at, period = rng.randint(0, len(w)), rng.randint(1, 12)
                w = w[:at] + (w[at : at + period] * 60)[: rng.randint(1, 60)] + w[at:]
            texts.append(w)
        for w, found in zip(texts, runs.looked_at(texts), strict=True):
            assert found == plain_runs(w)
            kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
            assert runs.collapsed(w, found) == b" ".join(kept).decode()
            seen += len(found)
    assert seen > 4000


def test_long_texts_of_few_words_take_little_work():
    for w in ([b"a"] * 400_000, [b"x", b"y", b"x", b"z"] * 100_000, ([b"-"] * 20 + [b"t"]) * 20_000):
        ids = np.unique(np.array(w), return_inverse=True)[1]
        place, _, _ = runs.occurrences(ids, len(ids) // 4)
        assert len(place) <= 2 * len(w)  # what the loop over words meets
        (start, length, period), *_ = sorted(runs.looked_at([w])[0], key=lambda r: -r[1])
        assert (start, length) == (0, len(w)) and period in (1, 4, 21)


def test_planted_runs_and_odd_rows(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "one two\x0bthree four", *[" ".join(rng.choices(["aa", "b", "é"], k=rng.randint(1, 70))) for _ in range(250)]]
    rows = [(i, t, 1, "k", 2, 3, 4) for i, t in enumerate(texts)] + [(7, texts[7], 1, "k", 2, 3, 4), (None, "x x x x x x", 1, "k", 2, 3, 4)]
    df = spark.createDataFrame(rows, DOCS)
    found = runs.periodic_runs(df, text=runs.planted(F.col("doc_id"), F.col("text"))).collect()
    assert len(found) == len(rows)
    for r in found:
        words = (next(t for i, t, *_ in rows if i == r["doc_id"]) or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and words:
            a = (h // 10) % len(words)
            p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        assert [tuple(x) for x in r["runs"]] == plain_runs(words) and r["n_words"] == len(words)
    assert runs.summed_up(runs.periodic_runs(df.limit(0))).count() == 0


def plain_codes(vectors, ids, entries, rounds):
    x = np.array(vectors, dtype=object)  # Python's own numbers: squares may be large
    parts = np.array_split(x, 4, axis=1)
    books = [p[np.argsort(ids, kind="stable")[:entries]].copy() for p in parts]

    def nearest(p, book):
        return [min(range(len(book)), key=lambda e: (int(((row - book[e]) ** 2).sum()), e)) for row in p]

    for _ in range(rounds):
        for p, book in zip(parts, books, strict=True):
            code = np.array(nearest(p, book))
            for e in set(code):
                book[e] = p[code == e].sum(0) // (code == e).sum()
    codes = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    error = [sum(int(((p[i] - b[c[i]]) ** 2).sum()) for p, b, c in zip(parts, books, codes, strict=True)) for i in range(len(x))]
    return list(zip(*codes, strict=True)), error, books


@pytest.mark.parametrize(("width", "kind"), [(8, "ties"), (10, "spread"), (8, "huge")])
def test_codes_equal_plain_lloyd(spark, width, kind):
    rng = np.random.default_rng(3)
    x = {"ties": rng.integers(-2, 3, (400, width)) / 1024, "spread": rng.normal(0, 0.2, (400, width)), "huge": rng.integers(-9, 9, (300, width)) * 2.0**40}[kind]
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, [float(v) for v in r], i % 3 if i % 5 else None, 1, 2) for i, r in zip(ids, x, strict=True)]
    odd = [(1000, None, 1, 1, 2), (1001, [], 1, 1, 2), (1002, [float("nan")] * width, 1, 1, 2), (1003, [None, *[1.0] * (width - 1)], 1, 1, 2), (1004, [float("-inf")] * width, 1, 1, 2), (1005, [1.0] * (width + 1), 1, 1, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, entry int, error int")
    found, books = vector_codes.compress(df, entries=40)
    codes, error, plain = plain_codes([[int(np.floor(v * 1024)) if abs(v) < 2**40 else int(v) * 1024 for v in r] for r in x], ids, 40, 4)
    got = {r["vec_id"]: r for r in vector_codes.label_errors(found).collect()}
    assert len(got) == len(x) and all((a == b).all() for a, b in zip(books, plain, strict=True))
    by_label = {}
    for i, c, e in zip(ids, codes, error, strict=True):
        by_label.setdefault(i % 3 if i % 5 else None, []).append(min(e, 2**63 - 1))
        assert tuple(got[i]["codes"]) == c and got[i]["error"] == min(e, 2**63 - 1)
    assert {r["label"]: r["label_error"] for r in got.values()} == {k: min(sum(v), 2**63 - 1) for k, v in by_label.items()}


def test_codes_of_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], None)] * 5 + [(None, [1.0, 2.0, 3.0, 5.0], None)], "vec_id long, embedding array<float>, label string")
    found, books = vector_codes.compress(df)
    assert sorted((tuple(r["codes"]), r["error"]) for r in found.collect()) == [((0, 0, 0, 0), 0)] * 5 + [((0, 0, 0, 5), 0)]
    none, books = vector_codes.compress(df.limit(0))
    assert vector_codes.label_errors(none).count() == 0 and all(len(b) == 0 for b in books)


def test_nearest_prunes_and_takes_whole_nodes(monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1000, (64, 4)).round()
    x = np.repeat(middles, 200, axis=0) + rng.integers(-3, 4, (64 * 200, 4))
    looked = []
    plain = vector_codes.not_beaten
    monkeypatch.setattr(vector_codes, "not_beaten", lambda *a: looked.append(1) or plain(*a))
    codes, n, sums = vector_codes.nearest(x, middles)
    assert (codes == np.repeat(np.arange(64), 200)).all() and (n == 200).all()
    assert (sums == np.add.reduceat(x, np.arange(0, len(x), 200), axis=0)).all()
    assert len(looked) < 1000  # of 12,800 rows


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("common_ones", [1 << 20, 300, 0.5])
def test_token_counts_equal_the_library(spark, name, common_ones):
    rng = random.Random(4)
    bits = ["<|endoftext|>", " ", "  ", "'s", "ab", "é", "漢字", "ก็", "1", "\n", "İ", "́", "-", "<|", "😀", "\t ", "x" * 70, "\u0085", "\x00\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(300)] + [None, "", "word " * 20_000, "a" * 20_000]
    rows = [(i % 290 if i % 7 else None, t, 1, "k", 2, 3, 4) for i, t in enumerate(texts)]
    got = token_counts.token_counts(spark.createDataFrame(rows + rows[:9], DOCS), path=tokenizer_path(name), common=common_ones).collect()
    if name.endswith(".model"):
        import sentencepiece

        length = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_path(name))
        length = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted([(i, len((t or "").encode()), length(t or "")) for i, t, *_ in rows + rows[:9]], key=key)


def test_token_counts_of_unsteady_and_empty_tables(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the"), F.col("id")).alias("text")).repartition(5)
    found = token_counts.token_counts(df, common=20, fixed=False).collect()
    assert len({r["doc_id"] for r in found}) == 500 and all(r["n_bytes"] == 4 + len(str(r["doc_id"])) for r in found)
    assert token_counts.token_counts(df.limit(0)).count() == 0
    common.clean(spark)
    table = common.written(spark.range(3))
    assert table.count() == 3
    common.clean(spark)
    assert not spark._jvm.java.io.File(table.inputFiles()[0].removeprefix("file:")).exists() if table.inputFiles() else True


def test_queries_return_their_contracts(spark):
    kinds = {
        "op11_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
        "op12_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
        "op13_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    }
    for name, kind in kinds.items():
        assert dict(llm.QUERIES[name](spark, SF).dtypes) == kind
