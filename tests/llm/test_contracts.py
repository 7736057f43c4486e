"""What the operators promise, against plain versions: sums, patterns, paths, trees, long texts,
repeated rows, hot keys, and the SQL of the queries."""

import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import common, langid, mixing, packing, pii_crf, quality, sharding, simhash, toxicity
from hushframe.llm import queries as llm
from hushframe.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
LONG = ["a" * 1_000_000, "a." * 500_000, "!" * 1_000_000, "7" * 1_000_000, "a 7 " * 250_000, "@" * 1_000_000, "7!" * 500_000, "x" * 999_999 + "7", "+1 " * 300_000]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    key = lambda rows, columns: sorted(repr([(c, float(r[c]) if isinstance(r[c], float) else r[c]) for c in sorted(columns)]) for r in rows)
    mine = llm.QUERIES[name](spark, SF)
    found = con.sql(llm.SQL[name])
    theirs = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(mine.columns) == sorted(found.columns)
    assert key([r.asDict() for r in mine.collect()], mine.columns) == key(theirs, mine.columns) != []


def test_shards_of_the_query_have_several_depths(spark):
    found = llm.op3_sharding(spark, "/root/testdata/sf0.01").groupBy("depth", "bucket", "chain").agg(F.sum("bytes").alias("b"))
    assert found.select("depth").distinct().count() > 1 and found.agg(F.max("b")).first()[0] <= sharding.QUERY_LIMIT


def test_written_shards(spark, tmp_path):
    docs = table(spark, "documents").withColumn("row", F.lit(1)).withColumn("id", F.lit("x"))
    sharding.write_shards(docs, f"file://{tmp_path}/s", 40_000)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0] <= 40_000
    sharding.write_shards(docs.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="different"):
        sharding.write_shards(docs.union(docs), f"file://{tmp_path}/twice")


def test_raw_scores_are_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=40), rng.normal(size=(40, 4))
    rows = [np.sort(rng.choice(40, n, replace=False)) for n in (0, 1, 2, 9)]
    plain = [0.3 + sum(w[i] for i in r) + sum(v[i] @ v[j] for i, j in itertools.combinations(r, 2)) for r in rows]
    np.testing.assert_allclose(toxicity.raw(0.3, w, v, rows), plain)


def test_a_repeated_id_is_one_row_of_the_fit(spark):
    docs = spark.createDataFrame([(i % 7, f"word{'abcdefg'[i % 7]} some text", None) for i in range(300)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    assert len(model.index) == 2  # "some" and "text": each other word stands in one document
    assert quality.train(docs, labels) is None  # all of them too short
    assert toxicity.train(docs.limit(0), labels) is None and toxicity.train(docs, labels.limit(0)) is None


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(d[-1::-2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) % 10:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    parts = ["@", ".", "a", "b-", "1", "25", "300", "+", " ", "-", "(", ")", "é", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 415 555 01 00", "٣", "\n", "_", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii_crf.base_spans(text) == plain_spans(text), text


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    n = len(pii_crf.LABELS)
    move = rng.normal(size=(n, n))
    scores = [rng.normal(size=(length, n)) for length in (1, 2, 3, 3, 4)]
    for s, got in zip(scores, pii_crf.viterbi(scores, move), strict=True):

        def total(path, s=s):
            ok = pii_crf.FIRST[path[0]] and all(pii_crf.ALLOWED[a, b] for a, b in itertools.pairwise(path))
            return sum(s[t, x] for t, x in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)) if ok else -np.inf

        assert tuple(got) == max(itertools.product(range(n), repeat=len(s)), key=total)


def test_words_before_a_run():
    assert [r[0] for r in pii_crf.runs("Call (me): 12\nnow 3 " + "y" * 90 + " z 4")] == [("call", "me"), ("", "now"), ("y" * 90, "z")]


def test_counts_against_plain_ones():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c ", "# ", "\n", "\t", "é", " ", "a b c\n", "\u2003"]) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeat = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        assert quality.measure(text)[0] == [len(words), sum(map(len, words)), text.count("#"), dup, len(repeat)]


def test_forest_against_a_plain_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    f = quality.grow(x, np.ones(400, bool), trees=20, sample=64)

    def path(row, node, depth=0):
        if f.stat[node] < 0:
            return f.length[node]
        return path(row, (f.left if row[f.stat[node]] < f.value[node] else f.right)[node], depth + 1)

    plain = [2 ** -(np.mean([path(r, root) for root in f.roots]) / f.expected) for r in x[:50]]
    np.testing.assert_allclose(f.score(x[:50]), plain)
    assert f.score(np.array([[9.0, 9.0, 9.0]]))[0] > np.quantile(f.score(x), 0.99)


@pytest.mark.parametrize("text", LONG, ids=lambda t: repr(t[:4]))
def test_long_texts_take_little_time(text):
    model = pii_crf.trained()
    for run in (
        lambda: pii_crf.all_spans(model, [text]),
        lambda: quality.measure(text),
        lambda: toxicity.terms(text),
        lambda: simhash.fingerprints([text.encode()]),
        lambda: langid.build(["a"], np.array([0x61616161]), np.array([1])).lengths([text]),
        lambda: Encoder.get(tokenizer_path("byte_bpe_50k.json")).ids(text),
        lambda: Encoder.get(tokenizer_path("word_bpe_49k.json")).ids(text),
    ):
        began = time.process_time()
        run()
        assert time.process_time() - began < 30  # quadratic ones take hours


def test_hot_keys_are_joined_whole(spark):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(6000)], "k long, i long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    for least in (5, 100_000):
        found = common.join_hot(left, right, "k", "n", least, 100)
        assert found.columns == ["k", "i", "n", "v"] and found.agg(F.count(F.lit(1)), F.sum("i"), F.sum("v")).first() == left.join(right, "k").agg(F.count(F.lit(1)), F.sum("i"), F.sum("v")).first()


def test_rows_alike_are_ranked_in_many_tasks(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("a").alias("g"), F.lit(1).alias("o"))
    ranked = common.sorted_ranks(rows, ["g"], ["o"])
    assert ranked.select("rank").distinct().count() == 20_000 == ranked.agg(F.max("rank")).first()[0] + 1


ODD = "doc_id long, text string, source string, lang string, id string, row int, rank int, copies string, rows int, turn int, h int, n_chars long"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", 1, 2, "c", 3, 4, 5, 6) for i, t, s in rows], ODD)


def test_rows_are_taken_as_often_as_the_mix_says(spark):
    rows = [(i, f"w{i} " * (i % 9), "ab"[i % 2]) for i in range(60)] + [(None, "some words", None)] * 50 + [(7, "again", "a")] * 3 + [(100, None, "a"), (101, "", None)]
    docs = odd(spark, rows)
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert sorted(map(repr, taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect())) == sorted(map(repr, copies.collect()))
    assert taken.where("doc_id is null").count() > 1
    empty = mixing.take(docs.limit(0))
    assert empty.count() == 0 and empty.columns == docs.columns


def test_one_of_each_group_stays_in_odd_tables(spark):
    text = "one two three four five six seven"
    docs = odd(spark, [(5, text, "a")] * 4 + [(9, text.upper(), "b"), (None, text, "a"), (3, None, "a"), (4, "", "b"), (8, "quite other words in here", "a")])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 8]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_search_ends_by_itself_or_by_its_steps():
    plan, proved = packing.search({6: 4, 5: 4, 4: 4}, 15)
    assert proved and sum(t for _, t in plan) == 4
    histogram = {x: 3 for x in range(600, 1100)}
    plan, proved = packing.search(histogram, 2048, steps=50)
    assert not proved and sum(x * t for f, t in plan for x in f) == sum(x * n for x, n in histogram.items())


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master, checkpoint = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.checkpoint

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
