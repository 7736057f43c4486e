"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and
on nulls, empty tables, ties, repeated rows and columns with clashing names."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hushframe.llm import langid, mixing, packing, pii_crf, quality, sharding, simhash, token_files, topk, toxicity
from hushframe.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, size int, score double, rank int, id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 0.5, 2, 3) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like our own."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    some = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i in range(120)]
    long = " ".join(rng.choices(words, k=30_000))
    return docs(spark, [*some, some[3], some[3], (None, None, None, None), (500, None, "en", "a"), (501, "", "en", "a"), (502, long, "en", "b"), (503, long + " x", "en", "b")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 != 0, int(i % 4 == 0)) for i in range(100)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic")


def real(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_odd_rows_and_empty_tables(spark, odd, labels):
    for run in (
        lambda d: toxicity.toxicity(d, labels),
        lambda d: pii_crf.pii(d),
        lambda d: sharding.shards(d, 2000),
        lambda d: simhash.near_duplicates(d),
        lambda d: quality.rules(d, labels),
        lambda d: langid.identify(d),
        lambda d: mixing.mix(d),
        lambda d: token_files.round_trip(d),
    ):
        assert run(odd).count() == odd.count()
        assert run(odd.limit(0)).count() == 0
    assert packing.pack(odd.limit(0)).count() == 0
    assert packing.pack(odd).groupBy("doc_id", "piece", "start").count().where("doc_id = 3").first()["count"] == 3


def test_toxicity_held_out(spark):
    found = toxicity.toxicity(real(spark, "documents"), real(spark, "labels")).join(real(spark, "labels"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.93
    assert found[found.toxic == 0].predicted.mean() < 0.02


def test_fm_learns_a_pair():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([1] * int(a) + [2] * int(b) + [3], np.int64))
        y.append(int(a and b))
    m = toxicity.fit(rows, np.array(y))
    score = lambda *t: 1 / (1 + np.exp(-(m.scale * m.raw([np.array([m.index[x] for x in t if x in m.index])]) + m.shift)))[0]
    assert score(1, 2) > 0.9 and score(1) < 0.1 and score(2) < 0.1


def test_fm_learns_a_pair_of_terms_neutral_alone():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([1] * int(a) + [2] * int(b) + sorted(set(rng.integers(10, 300, 10).tolist())), np.int64))
        y.append(int(a == b))
    m = toxicity.fit(rows[:2000], np.array(y[:2000]))
    found = m.scale * m.raw([np.array([m.index[x] for x in r.tolist() if x in m.index], np.int64) for r in rows[2000:]]) + m.shift
    assert ((found > 0) == (np.array(y[2000:]) == 1)).mean() > 0.95
    assert {1, 2, *range(10, 300)} <= set(m.index)


def test_a_harmless_context_lowers_the_score():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(3000):
        insult, quoted = rng.random(2) < (0.2, 0.5)
        rows.append(np.array([1] * int(insult) + [2] * int(quoted) + [3], np.int64))
        y.append(int(insult and not quoted))
    m = toxicity.fit(rows, np.array(y))
    score = lambda *t: 1 / (1 + np.exp(-(m.scale * m.raw([np.array([m.index[x] for x in t])]) + m.shift)))[0]
    assert score(1, 3) > 0.9 and score(1, 2, 3) < 0.1


def test_base_spans():
    text = "a@b.c x@y 1.2.3.4 1.2.3.256, 4111 1111 1111 1111 +1 (415) 555-0100 +12 999"
    assert pii_crf.base_spans(text) == [("email", 0, 5), ("ip", 10, 17), ("card", 29, 48), ("phone", 49, 66)]
    assert pii_crf.base_spans("1" * 20_000 + "@" + "." * 9) == []


def test_crf_finds_what_patterns_miss():
    model = pii_crf.trained()
    rows = pii_crf.labelled(seed=77)
    found = pii_crf.model_spans(model, [r[0] for r in rows])
    hit, wrong, missed = (sum(len(x) for x in z) for z in zip(*[(set(f) & set(g), set(f) - set(g), set(g) - set(f)) for f, (_, g) in zip(found, rows, strict=True)], strict=True))
    assert hit > 0.95 * (hit + missed) and wrong < 0.05 * hit


@pytest.mark.parametrize("n", [0, 255, 256, 1023])
def test_a_long_run_is_decoded_whole(n):
    emit = np.zeros((2, len(pii_crf.LABELS)))
    emit[0, pii_crf.LABELS.index("B-phone")] = emit[1, pii_crf.LABELS.index("I-phone")] = 9
    model = pii_crf.Model({"shape=(d)": 0, "shape=d-d": 1}, emit, np.zeros((len(pii_crf.LABELS),) * 2))
    text = "a1 " * n + "(415) 555-0123" + " a1" * 600
    assert pii_crf.model_spans(model, [text, "b2", text])[::2] == [[("phone", 3 * n, 3 * n + 14)]] * 2
    assert len(pii_crf.runs(text)) == 1


@pytest.mark.parametrize("form", ["(4{}) 555-{}", "4{} 555 {}"])
def test_a_directory_on_one_line(form):
    numbers = [form.format(i % 90 + 10, 1000 + i) for i in range(300)]
    text = " ".join(numbers)
    assert [text[a:b] for _, a, b in pii_crf.model_spans(pii_crf.trained(), [text])[0]] == numbers


def test_long_tokens_are_featured_whole():
    found = pii_crf.token_features("card:" + "-" * 70 + "4111111111111111")
    assert "luhn" in found and "shape=a:-d" in found
    features = list(pii_crf.features("7 " * 3 + "1 " * 9 + "x" * 70 + "1", pii_crf.runs("7 " * 3 + "1 " * 9 + "x" * 70 + "1")[0]))
    total = "777" + "1" * 10
    assert all("run=<=15" in f and ("run-luhn" in f) == pii_crf.luhn(total) for f in features)


def test_redacted():
    assert pii_crf.redacted("ab cd ef", [("card", 3, 5), ("phone", 4, 8)]) == "ab [CARD]"


@pytest.mark.parametrize("limit", [300, 2000, 100_000])
def test_shards_fit(spark, odd, limit):
    found = sharding.shards(odd, limit).groupBy("depth", "bucket", "chain").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["b"] <= limit or r["n"] == 1 for r in found)


def test_repeated_rows_over_the_limit_are_chained(spark):
    found = sharding.shards(docs(spark, [(1, "x" * 40, "en", "a")] * 25 + [(2, "y", "en", "a")]), 100).groupBy("depth", "bucket", "chain").agg(F.sum("bytes").alias("b"))
    assert found.agg(F.max("b")).first()[0] <= 100 and found.count() >= 13


@pytest.mark.parametrize("scale,zeros", [(0.2, 0), (1, 0.7), (2e4, 0), (1e6, 0.3), (1e9, 0)])
def test_top_k_against_brute_force(spark, scale, zeros):
    rng = np.random.default_rng(3)
    v = rng.normal(0, scale, (1500, 16))
    v[100:400] = v[100]
    v[rng.random(v.shape) < zeros] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9100, [float("nan")] * 16), (9200, [1.0, None]), (None, [1.0] * 16)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, group_bytes=800, shard=400).toPandas()
    q = np.array([[int(np.floor(1024 * x)) for x in r] for r in v], object)
    assert len(found) == 150
    for query in range(0, 1500, 100):
        s = q @ q[query]
        order = sorted((i for i in range(1500) if i != query), key=lambda i: (-s[i], i))[:10]
        mine = found[found.query_id == query].sort_values("rank")
        assert mine.vec_id.tolist() == order and mine.score.tolist() == [min(int(x), 2**63 - 1) for x in s[order]]


def test_top_k_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, rank int, score double, id int, v string, asks int"
    ask = F.col("vec_id") % 100 == 0
    none = spark.createDataFrame([], kind)
    assert topk.top_k(none, ask).count() == 0
    few = [(100, [1.0, 2.0], 1, 0.5, 3, "x", 1), (1, [1.0], 1, 0.5, 3, "x", 1), (1, [1.0], 1, 0.5, 3, "x", 1), (2, [], 1, 0.5, 3, "x", 1), (3, [-1.0, 0.0, 5.0], 1, 0.5, 3, "x", 1)]
    found = topk.top_k(spark.createDataFrame(few, kind), ask).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(100, 1, 1, 1 << 20), (100, 2, 1, 1 << 20), (100, 3, 2, 0), (100, 4, 3, -1 << 20)]
    assert topk.top_k(spark.createDataFrame(few, kind), F.col("vec_id") < 0).count() == 0


def plain_fingerprint(text):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def groups(values, distance):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance) + i + 1:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprints():
    texts = ["", "One", "a b c d e f g A B C", "été " * 50, "x y " * 3000]
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("dense", [2, 64])
def test_links_against_all_pairs(spark, distance, dense):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base:  # families of edited copies, dense and sparse
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    values = np.array(sorted(values), np.uint64)
    from hushframe.llm.graph import components

    links = simhash.links(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long"), distance, dense)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    mine = [got.get(int(x), int(x)) for x in values.view(np.int64)]
    want = groups(values, distance)
    pairs = set(zip(mine, want, strict=True))
    assert len(pairs) == len(set(mine)) == len(set(want))


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(7, text, "en", "a"), (3, text, "en", "b"), (3, text, "en", "b"), (9, "other words here", "en", "a"), (None, text, "en", "a")]
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()) == [3, 9]


def test_rule_statistics():
    text = "a b c a b c\nx # é\n\nx # é\n" + "w " * 3
    counts, _ = quality.measure(text)
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeat = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    assert counts == [len(words), sum(map(len, words)), 2, 1, len(repeat)]


@pytest.mark.parametrize("n", [60, 400, 799, 800, 801, 5000])
def test_distinct_words_are_counted_over_all_words(n):
    share = lambda words: quality.measure(" ".join(words))[1][quality.STATS.index("distinct")]
    unlike = [f"w{i}" for i in range(n)]
    assert share(unlike) == 1
    # every other word repeats: in step with a stride of two, or between its steps
    for first in (0, 1):
        words = list(unlike)
        words[first::2] = ["x"] * len(words[first::2])
        blocks = [words[at : at + 400] for at in range(0, n, 400)]
        assert share(words) == sum(len(set(b)) for b in blocks) / n
        assert 0.49 < share(words) < 0.54


def test_quality_keeps_good_documents(spark):
    found = quality.rules(real(spark, "documents"), real(spark, "labels")).join(real(spark, "labels"), "doc_id").where("not base_failed").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.97
    assert found[found.quality == 0].kept.mean() < 0.7


def test_language_held_out(spark):
    found = langid.identify(real(spark, "documents")).join(real(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.98


def test_code_lengths_against_a_plain_coder():
    texts = {"a": ["abab abba", "baba aab"], "b": ["cdcd dccd", "dcdc ccd"]}
    grams = [(k, p[i : i + 4]) for k, ts in texts.items() for t in ts for p in [b"   " + t.encode()] for i in range(len(p) - 3)]
    keys = sorted(set(grams))
    m = langid.build([k for k, _ in keys], np.array([int.from_bytes(g, "big") for _, g in keys]), np.array([grams.count(k) for k in keys]))

    def plain(lang, text):
        raw, total = b"   " + langid.folded(text), 0.0
        mine = [g for k, g in grams if k == lang]

        def p(context, c):
            seen = [g[3] for g in mine if g[3 - len(context) : 3] == context]
            lower = p(context[1:], c) if context else 1 / 256
            if not seen:
                return lower
            n, d = len(seen), len(set(seen))
            return seen.count(c) / (n + d) if c in seen else d / (n + d) * lower

        for i in range(3, len(raw)):
            total -= np.log2(p(raw[i - 3 : i], raw[i]))
        return total

    for text in ("abba cab", "dcd", "aaaa", "xyz abc"):
        np.testing.assert_allclose(m.lengths([text])[0], [plain("a", text), plain("b", text)], rtol=1e-4)


def test_packing(spark, odd):
    found = packing.pack(odd, length=64, keep_ids=True).toPandas()
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length).tolist()[:-1]] and s.length.sum() <= 64
    short = found[found.length < 64].length.value_counts().to_dict()
    assert found.sequence_id.nunique() == (found.length == 64).sum() + sum(t for _, t in packing.solve(short, 64))
    encode = Encoder.get(tokenizer_path("byte_bpe_50k.json"))
    for r in odd.where("doc_id in (5, 500, 502)").collect():
        ids = encode.whole(r["text"] or "") + b"\0\0\0\0"
        mine = found[found.doc_id == r["doc_id"]].sort_values("piece")
        assert b"".join(mine.ids) == ids and mine.length.iloc[1:].eq(64).all()
        assert [zlib.crc32(x) for x in mine.ids] == mine.ids_crc32.tolist()


def test_plans_against_the_optimum():
    def fewest(items, room):
        best = len(items)

        def go(rest, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if not rest:
                best = len(bins)
                return
            for i in {b: i for i, b in enumerate(bins)}.values():
                if bins[i] + rest[0] <= room:
                    go(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
            go(rest[1:], [*bins, rest[0]])

        go(sorted(items, reverse=True), [])
        return best

    rng = random.Random(4)
    for _ in range(30):
        items = [rng.randint(1, 30) for _ in range(9)]
        plan = packing.solve({x: items.count(x) for x in items}, 30)
        assert sorted(x for f, t in plan for x in f * t) == sorted(items) and all(sum(f) <= 30 for f, _ in plan)
        assert sum(t for _, t in plan) == fewest(items, 30)


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, "<u4"), np.array([2**32 - 1, 0], "<u4"), rng.integers(0, 50_000, 1000).astype("<u4"), np.full(512, 7, "<u4"), np.where(np.arange(700) % 50, 3, 4_000_000_000).astype("<u4")):
        f = token_files.File(token_files.encode_file(["1", None], [len(ids), 0], ids))
        assert f.read(0, len(ids)).tolist() == ids.tolist() and f.keys == ["1", None]
        assert f.read(300, 600).tolist() == ids[300:600].tolist() if len(ids) >= 600 else True


def test_token_files(spark, odd):
    found = token_files.round_trip(odd, file_ids=500).toPandas().sort_values("start")
    assert found.start.tolist() == [0, *np.cumsum(found.n_tokens).tolist()[:-1]]
    ids = found.doc_id.dropna().tolist()
    assert ids == sorted(ids)
    encode = Encoder.get(tokenizer_path("word_bpe_49k.json"))
    for r in odd.where("doc_id in (5, 500, 502)").collect():
        raw = encode.whole(r["text"] or "") + b"\1\0\0\0"
        assert found[found.doc_id == r["doc_id"]].ids_crc32.tolist() == [zlib.crc32(raw)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(name):
    from tokenizers import Tokenizer

    rng, library, e = random.Random(2), Tokenizer.from_file(tokenizer_path(name)), Encoder.get(tokenizer_path(name))
    same = lambda text: e.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    points = [*range(0x250), *range(0x2010, 0x205F), *range(0x300, 0x310), 0x130, 0x3A3, 0x4E2D, 0x1F600]
    assert [c for c in points if not same(f"a{chr(c)}b {chr(c)} {chr(c)}")] == []
    strings = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "'s", "the", "\x1c", "²", "Ə"]
    for k in range(20_000):
        text = "".join(chr(rng.choice(points)) if k % 2 else rng.choice(strings) for _ in range(rng.randint(0, 20)))
        assert same(text), text
    assert same("x" * 50_000) and same("a<|endoftext|>")


def test_mix(spark, odd):
    found = mixing.mix(odd).toPandas()
    by = found.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum() and (by.target <= 2 * by["size"] + 1e-9).all()
    assert found.copies.between(0, 2).all()
    again = mixing.mix(odd.repartition(7)).toPandas()
    key = lambda x: sorted(map(repr, x[["doc_id", "size", "taken"]].values.tolist()))
    assert key(found) == key(again)
    taken = mixing.take(odd.where("doc_id < 100"))
    assert taken.count() == mixing.mix(odd.where("doc_id < 100")).agg(F.sum("copies")).first()[0]
    assert taken.columns == odd.columns


def test_quality_is_fitted_on_all_labelled_rows(spark):
    """A forest's threshold is that of the scores of all rows, which are more than one task or a sample holds."""
    n = 24_000
    word = F.concat(F.lit("w"), F.col("k").cast("string"), F.lit("x"), F.col("doc_id").cast("string"))
    end = F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit(" 9|!"), (F.col("doc_id") % 37).cast("int"))).otherwise(F.repeat(F.lit(" Ab,"), (F.col("doc_id") % 23).cast("int")))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(52)))).groupBy("doc_id").agg(F.array_join(F.collect_list(word), " ").alias("text")).withColumn("text", F.concat("text", end))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 > 0).cast("int").alias("quality"))
    forest = quality.train(docs, labels)
    rows = docs.select("doc_id", "text").toPandas()
    counts, x = quality.measured(pa.array(rows.text))
    assert not quality.failed(counts).any()
    scores, good = forest.score(x), rows.doc_id.to_numpy() % 10 > 0
    tries = np.unique(np.quantile(scores, np.linspace(0, 1, quality.TRIES)))
    kept, dropped = (scores[good][:, None] <= tries).mean(0), (scores[~good][:, None] > tries).mean(0)
    assert abs(forest.threshold - quality.best(tries, kept, dropped, quality.KEEP)) < 1e-9
    told = quality.rules(docs, labels).toPandas().set_index("doc_id").kept
    assert told[[i for i in range(n) if i % 10]].mean() >= quality.KEEP


def test_common_pieces_are_asked_of_the_model_once():
    name = tokenizer_path("byte_bpe_50k.json")
    e, asked = Encoder(name, most=64), []
    make = e.known.make
    e.known.make = lambda piece: asked.append(piece) or make(piece)
    texts = [f" common w{'xyz'[k % 3] * (k % 7 + 1)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} {'long' * 20} {'long' * 20}" for k in range(600)]
    assert [e.ids(t) for t in texts] == [e.whole(t) for t in texts]
    assert asked.count(" common") == 1 and asked.count(" " + "long" * 20) == 600
    assert len(e.known) + len(e.known.before) <= 64
