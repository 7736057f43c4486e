"""Token alignment, two rounds of a name model, language tags and terms as a table, against plain versions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from hushframe.operators import entities, findings, redact, terms


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")).lower()


def plain_places(text, words):
    """Word by word, searching all of the rest of the text."""
    norm, at = "", []
    for i, c in enumerate(text):
        norm += fold(c)
        at += [i] * len(fold(c))
    cursor, out = 0, []
    for k, w in enumerate(words):
        w = fold(re.sub("^▁", "", re.sub("^##", "", w or "")).strip())
        found = norm.find(w, cursor) if w and w != "[unk]" else -1
        if found < 0 or found - cursor > 40:
            continue
        cursor = found + len(w)
        end = at[cursor - 1] + 1
        while end < len(text) and unicodedata.category(text[end]).startswith("M"):
            end += 1
        out.append((k, at[found], end))
    return out


def test_aligned_like_a_plain_walk(spark):
    rng = random.Random(2)
    bits = ["Anna", "É", "é", "กำ", "ก็", " ", "\n", "ß", "İ", "x" * 45, "Ça", "ﬁ", "12", "😀", "-"]
    rows = []
    for _ in range(400):
        pieces = [rng.choice(bits) for _ in range(rng.randint(0, 14))]
        words = [rng.choice(["", "##", "▁", "##▁"]) + fold(p) for p in pieces if rng.random() < 0.8] + rng.choices(["[UNK]", "none", None, ""], k=rng.randint(0, 2))
        rows.append(("".join(pieces), words))
    rows += [(None, ["a"]), ("a", None), ("", []), ("กำลังพิมพ์", ["กำลงพมพ"]), ("x" * 41 + "ann", ["ann"]), ("x" * 40 + "ann", ["ann"])]
    got = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(rows)], "i int, t string, w array<string>").select("i", entities.aligned(F.col("t"), F.col("w")).alias("p")).collect()
    found = {r["i"]: [tuple(p) for p in r["p"]] for r in got}
    assert found == {i: plain_places(t or "", w or []) for i, (t, w) in enumerate(rows)}
    assert found[len(rows) - 3] == [(0, 0, 10)] and found[len(rows) - 2] == [] and found[len(rows) - 1] == [(0, 40, 43)]


def test_tokens_with_places_make_names(spark):
    tokens = [(1, k, "Frau Ána García, x", w, e, 0.9) for k, (w, e) in enumerate([("frau", "O"), ("ana", "B-PER"), ("gar", "I-PER"), ("##cia", "I-PER"), ("[UNK]", "I-PER")])]
    placed = entities.with_places(spark.createDataFrame(tokens, "c int, n int, chunk string, word string, entity string, score double"), ["c"])
    assert [tuple(r) for r in entities.named(placed, ["c"]).select("label", "start", "end").collect()] == [("PER", 5, 15)]


def test_places_in_texts_that_come_once(spark):
    text = "Frau Ána García, x"
    tokens = spark.createDataFrame([(1, 0, "frau", "O", 0.9), (1, 1, "ana", "B-PER", 0.9), (1, 2, "none", "O", 0.9)], "c int, n int, word string, entity string, score double")
    found = entities.with_places(tokens, ["c"], chunks=spark.createDataFrame([(1, text), (2, "frau")], "c int, chunk string"))
    assert "chunk" not in found.columns
    assert [tuple(r) for r in found.orderBy("start").select("c", "n", "start", "end", "value").collect()] == [(1, 0, 0, 4, "Frau"), (1, 1, 5, 8, "Ána")]


def test_languages_of_tags(spark):
    want = {"de-CH": "de", "zh": "zh-Hans", "zh-TW": "zh-Hant", "zh-Hant-CN": "zh-Hant", "ZH-mo": "zh-Hant", "it": "en", "pt-BR": "en", "TH": "th", "": "en", None: "en", "english": "en", "ja-JP": "ja"}
    models = {"de": "multi", "zh-Hans": "multi", "zh-Hant": "multi", "ja": "multi", "th": "th", "en": "en"}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", entities.language_of(F.col("t")).alias("l"), entities.model_of(F.col("t")).alias("m")).collect()
    assert {r["t"]: (r["l"], r["m"]) for r in got} == {k: (v, models[v]) for k, v in want.items()}


def test_two_rounds(spark):
    text = "Ann Lee\nBob met\nx1\nann in Rome\n"
    told = {text: [("PER", 0, 11, 0.6), ("MISC", 0, 3, 0.9), ("ORG", 8, 11, 0.1)], "Ann Lee": [("PER", 0, 7, 0.9)], "Bob met": [("PER", 0, 3, 0.84), ("ORG", 0, 3, 0.99)], "ann in Rome": [("PER", 0, 3, 0.99), ("LOC", 7, 11, 0.7)]}
    asked = []

    def infer(df):
        rows = df.collect()
        asked.extend(r["text"] for r in rows)
        return spark.createDataFrame([(r["key"], r["model"], r["text"], told.get(r["text"], [])) for r in rows], "key string, model string, text string, found array<struct<label:string,start:int,end:int,score:double>>")

    docs = spark.createDataFrame([(1, text, "en"), (2, text, "multi"), (3, None, "en"), (4, " \n", "en"), (5, text, "en")], "d int, text string, model string")
    got = {(r["d"], r["label"], r["start"], r["end"]) for r in entities.in_two_rounds(docs, ["d"], infer).collect()}
    whole = {("PER", 0, 7), ("PER", 8, 11), ("ORG", 8, 11)}
    assert got == {(d, *s) for d in (1, 5) for s in whole | {("PER", 0, 7), ("LOC", 26, 30)}} | {(2, *s) for s in whole}
    assert sorted(asked) == sorted([text, text, "Ann Lee", "Bob met", "ann in Rome"])  # once per text and model


def test_two_rounds_take_no_text_along_with_names(spark):
    """Lines need no window, and no row of a name has the text that it is read from."""
    docs = spark.createDataFrame([(1, "Ann Lee\nBob", "en")], "d int, text string, model string")
    infer = lambda df: df.withColumn("found", F.array(F.struct(F.lit("PER").alias("label"), F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit(0.9).alias("score"))))
    found = entities.in_two_rounds(docs, ["d"], infer)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(text#" not in plan and "Window" not in plan
    assert {tuple(r)[:4] for r in found.collect()} == {(1, "PER", 0, 7), (1, "PER", 8, 11)}


@pytest.mark.parametrize("seed", range(3))
def test_term_spans_equal_detect_terms(spark, seed):
    rng = random.Random(seed)
    bits = ["ann", "Ann", "lee", "é", "É", " ", "  ", "@", ".", "-", "(", "\n", "1", "漢", "ß", "a", "ſ", "K"]
    make = lambda most: "".join(rng.choice(bits) for _ in range(rng.randint(1, most)))
    own = list({x.lower(): x for x in [make(5).strip() for _ in range(60)] if x}.values())
    texts = [(i, make(60)) for i in range(150)] + [(500, None), (501, "")]
    df = spark.createDataFrame(texts, "doc int, text string")
    table = spark.createDataFrame([(t,) for t in [*own, *own[:3], None, " "]], "term string")
    got = {tuple(r) for r in terms.term_spans(df, table, ["doc"]).select("doc", "start", "end").collect()}
    want = {(r["doc"], r["s"]["start"], r["s"]["end"]) for r in df.select("doc", F.explode(redact.detect_terms(F.col("text"), own)).alias("s")).collect()}
    assert got == want and len(got) > 100
    assert terms.term_spans(df, table.limit(0), ["doc"]).count() == 0 and terms.term_spans(df.limit(0), table, ["doc"]).count() == 0


def test_term_spans_need_no_cross_join(spark):
    df = spark.createDataFrame([(1, "a")], "doc int, text string")
    plan = terms.term_spans(df, df.select(F.col("text").alias("term")), ["doc"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_details_of_any_length(spark):
    long = "x(" * 5_000
    raw = f"/Title ({long.replace('(', chr(92) + '(')}) %%EOF /Author <FEFF0041> /Subject (a\\\\) /Keywords () %%EOF"
    got = spark.createDataFrame([(raw.encode("latin-1"),)], "c binary").select(findings.old_details(F.col("c"), F.array().cast("array<string>")).alias("o")).first()["o"]
    assert got == [f"Title: {long}", "Author: A", "Subject: a\\"]


def test_findings_of_files(spark):
    rows = [(1, b"%%EOF %%EOF", {"Title": "t"}, ["a.txt", "", None]), (2, b"/Title (t) /Title (u) %%EOF %%EOF %%EOF", {"Title": "t"}, None), (3, b"%%EOF", None, []), (4, None, None, None)]
    files = spark.createDataFrame(rows, "d int, content binary, info map<string,string>, attached array<string>")
    got = findings.findings(findings.document_items(files, ["d"], F.col("info"), F.col("attached")), ["d"]).unionByName(findings.version_findings(files, ["d"], F.col("content"), F.col("info")))
    assert {(r["d"], r["level"], r["title"], tuple(r["items"])) for r in got.collect()} == {
        (1, "check", "Attached files", ("a.txt", "Attachment", "Attachment")),
        (1, "check", "Document details (metadata)", ("Title: t",)),
        (1, "leak", "2 saved versions in one file", ()),
        (2, "check", "Document details (metadata)", ("Title: t",)),
        (2, "leak", "3 saved versions in one file", ("Title: u",)),
    }
    assert "No leaks" not in "".join(r["report"] for r in findings.report(got, ["d"], F.lit("f")).collect())


def test_looks_of_words_on_a_page(spark):
    rng = random.Random(3)
    light = [[200.0 if x < 20 else 20.0 if x < 40 else rng.uniform(0, 255) for x in range(400)] for _ in range(30)]
    rows = spark.createDataFrame([(1, y, r) for y, r in enumerate(light)], "p int, y int, light array<double>")
    pages = spark.createDataFrame([(1, 400, 30)], "p int, width int, height int")
    boxes = [(0, 2.0, 5.0, 15.0, 10.0), (1, 22.0, 5.0, 15.0, 10.0), (2, 50.0, 5.0, 300.0, 10.0), (3, -20.0, 5.0, 19.0, 10.0), (4, -20.0, 5.0, 20.0, 10.0), (5, 401.0, 0.0, 5.0, 5.0), (6, 10.0, 0.0, 2.0, 20.0), (7, 18.0, 5.0, 8.0, 10.0)]
    got = {r["n"]: r["look"] for r in findings.word_looks(spark.createDataFrame([(1, *b) for b in boxes], "p int, n int, x double, y double, w double, h double"), rows, pages, ["p"]).collect()}
    assert got == {0: "hidden", 1: "covered", 2: None, 3: "outside", 4: None, 5: "outside", 6: "hidden", 7: None}
    single = spark.createDataFrame([(1, y, x, 255, 0, 0) for y in range(2) for x in (2, 0, 1)], "p int, y int, x int, r int, g int, b int")
    assert [[round(v, 9) for v in r["light"]] for r in findings.light_rows(single, ["p"]).collect()] == [[76.245] * 3] * 2


def test_term_matches_of_odd_words_equal_sql(spark, tmp_path):
    """Letters whose capital is two letters, and places of one term that overlap."""
    import duckdb

    from hushframe.plans import names

    texts = ["a b ß d the. the e", "STRASSE SS ss ß im strasse", "the. the. the. the. the. the.", "x the. The. the. y the. the."]
    duck = duckdb.connect()
    duck.sql(f"CREATE TABLE documents AS SELECT * FROM (SELECT unnest(range({len(texts)})) AS doc_id, unnest({texts!r}) AS text)")
    duck.sql(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = sorted(map(tuple, names.term_matches(spark, str(tmp_path)).collect()))
    assert got == sorted(duck.sql(names.SQL["term_matches"]).fetchall())
    assert (1, 14, 15) in got and (1, 11, 13) not in got and [r for r in got if r[0] == 2] == [(2, 0, 8), (2, 10, 18), (2, 20, 28)]


def test_term_spans_stay_in_their_task(spark, monkeypatch):
    """What passes the filter is not shuffled where terms are few, and the same is found where they are many;
    of overlapping runs of a term the first stays, also where a key has fewer atoms than the text."""
    texts = [(1, "a. a. a. a."), (2, "x aͅb AΙB aͅB"), (3, None), (4, ""), (5, "The the. THE"), (6, "a." * 9), (7, "b" * 300_000 + " the")]
    df = spark.createDataFrame(texts, "doc int, text string")
    table = spark.createDataFrame([("a. a.",), ("the",), ("aιb",), ("x.y",), ("\U00010400 b",)], "term string")
    want = {(1, 0, 5), (1, 6, 11), (2, 2, 5), (2, 6, 9), (2, 10, 13), (5, 0, 3), (5, 4, 7), (5, 9, 12), (7, 300_001, 300_004)}
    for small in (terms.SMALL, -1):
        monkeypatch.setattr(terms, "SMALL", small)
        found = terms.term_spans(df, table, ["doc"]).select("doc", "start", "end")
        assert sorted(map(tuple, found.collect())) == sorted(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (small < 0)


def test_plain_code_points():
    small, word, _ = terms.tables()
    assert all(terms.plain(chr(c)) == chr(small[c]) for c in range(0x110000))
    assert word[ord("é")] and word[ord("٣")] and not word[ord("_")]


def test_few_terms_meet_texts_without_a_shuffle(spark):
    """Also where Spark takes the table of documents, which the terms come from, for a large one."""
    from hushframe.plans import names

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = names.term_matches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
