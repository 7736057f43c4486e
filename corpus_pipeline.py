"""A corpus pipeline of five stages: language, near-duplicates, personal data, mix, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last keep the columns of
``documents``, whatever their names, and of an empty table make an empty one. Repeated rows
are documents of their own, but for the near-duplicates stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import langid, mixing, packing, pii_crf, simhash
from hushframe.llm.common import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those it rejects (null or empty text, or no
    letter) go. Where no row has a language to learn from, all texts with a letter stay."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = docs.select(F.struct("*").alias("row"), langid.predict(model, spark)(F.col("text")).alias("told"))
    return told.where(F.col("told.lang") != "und").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id. Texts without
    words, null ones included, are one group."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; null texts stay null."""
    clean = docs.select(F.struct("*").alias("row"), F.when(F.col("text").isNotNull(), pii_crf.redact(spark)(F.col("text"))).alias("clean"))
    changed = {"text": F.col("clean").alias("text"), "n_chars": F.length("clean").cast("long").alias("n_chars")}
    return clean.select(*[changed.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them; a null text has no words, and is
    taken like other short ones, a null source is a source."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: SQL can't express the model, the fingerprints and the tokenizer; tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
