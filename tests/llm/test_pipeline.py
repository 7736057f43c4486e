"""Stages of the pipeline against plain versions."""

import pytest

import corpus_pipeline
from hushframe.llm import mixing, pii_crf, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["some words here", None, "", "12 34 !", "écrit à a@b.org", "中文", "call +1 415 555 0100 now"]


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_language_and_redaction_without_a_language(spark, texts):
    rows = [(i, t, None, "a", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.language(spark, docs, "")
    lettered = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted(map(tuple, kept.collect())) == lettered
    found = sorted(map(tuple, corpus_pipeline.personal_data(spark, docs, "").collect()))
    plain = [t if t is None else pii_crf.redacted(t, pii_crf.all_spans(pii_crf.trained(), [t])[0][1]) for t in texts]
    assert [(r[0], r[1], r[4]) for r in found] == [(i, t, None if t is None else len(t)) for i, t in enumerate(plain)]


def odd_documents(spark):
    rows = [(i, f"these are some plain words of text number {'abcdefghij'[i % 10] * (i % 7 + 1)} for the test", "en", "src"[: i % 3 + 1], 10) for i in range(40)]
    rows += [(100 + i, "ceci est un texte de quelques mots en langue " + "fghij"[i % 5] * (i + 2), "fr", "b", 5) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (None, "a text that has no id at all", "en", None, 3), (203, "12 34", "en", "a", 5)]
    rows += [(204, "the same words in every row of this text", "en", "a", 7)] * 5 + [(205, "call +1 415 555 0100 or write to ann@example.org about the long text " * 400, "en", "b", 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, kind).selectExpr("*", "1 AS row", "'x' AS clean", "2 AS told", "3 AS rank", "4 AS id")


def test_all_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    by = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "pack"]
    kept = by["language"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    assert kept.count() == sum(bool(r.text) and any(map(str.isalpha, r.text)) for r in docs.collect())
    one = by["near_duplicates"](spark, kept, "").cache()
    prints = {r.fp: r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert one.count() == len(set(prints.values())) and one.columns == docs.columns
    clean = by["personal_data"](spark, one, "").cache()
    assert clean.columns == docs.columns and clean.where("text LIKE '%@%'").isEmpty() and not clean.where("text LIKE '%[EMAIL]%'").isEmpty()
    assert clean.where("n_chars <> length(text)").isEmpty() and clean.count() == one.count()
    mixed = by["mix"](spark, clean, "").cache()
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(clean).agg({"copies": "sum"}).first()[0]
    packed = by["pack"](spark, mixed, "").cache()
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()


def test_all_stages_on_empty_tables(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns and found.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").isEmpty()


def test_run_is_its_stages(spark, tmp_path):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        plain = stage(spark, plain, "")
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).select(keys).collect())) == sorted(map(repr, plain.select(keys).collect()))
