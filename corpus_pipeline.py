"""A corpus pipeline of five operators: language, near-duplicates, private data, mixture, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. An empty table gives an empty table in every stage; rows
that repeat a doc_id are documents of their own but for near-duplicates, where equal texts are one group anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import langid, mixing, packing, pii, simhash
from listwright.llm.common import fewer, fresh_dir
from listwright.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rejected ones have no letter or no text (null). lang becomes the prediction;
    a null lang is no label to learn from."""
    told = langid.identified(docs, langid.trained(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return fewer(told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near-duplicates: Jaccard similarity of 0.8 or more
    between sets of five-word shingles. A null doc_id counts as the largest; texts without words are alike."""
    return fewer(simhash.one_of_each(docs).select(*COLUMNS))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for private data by the session's key; n_chars is that of the new text, 0 of a null."""
    new = pii.pseudonymised(docs, key=pii.key_of(spark)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return fewer(new.select(*COLUMNS))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; one without words never. A null source is one of its own."""
    return fewer(mixing.repeated(mixing.mixed(docs).select(*COLUMNS, "copies")).select(*COLUMNS))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences. A null text is the end id alone."""
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"), 1)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("private_data", without_private_data),
    ("mixture", to_target_weights),
    ("packing", into_sequences),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
