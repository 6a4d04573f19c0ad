"""A training-data pipeline over ``documents``: language ID, quality, near-duplicates, mixing, BPE encoding.

Each stage takes the session, the documents left and the folder of the tables, and returns documents; the last returns
their encoding. A stage learns from and decides on the documents it is given.

All stages take nulls in any column, texts that are empty or very long, repeated rows, tables without rows, and further
columns of any name, which they leave out. What each case gives is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm import bpe_codec, language_id, mixing, near_dedup, quality
from playlog.llm.tables import DOCUMENT_COLUMNS, LABELS, documents, read, stored
from playlog.session import use_small_batches

# A document whose language is less likely than this is rejected; it is far below what any real text gets.
LEAST_LANGUAGE = 0.5
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a known language; those without a letter, or whose language can't be told, go.

    A null or empty text has no letter. Rows with a null id learn and stay as others do; repeated rows share their fate.
    Where no document has a language to learn from, none stays.
    """
    use_small_batches(spark)
    docs = docs.select(DOCUMENT_COLUMNS)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.identified(docs, model, LEAST_LANGUAGE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.

    A null text counts as an empty one, whose score is learned like any other. Rows with a null id have no label and are
    judged all the same; repeated rows share their fate.
    """
    use_small_batches(spark)
    docs = docs.select(DOCUMENT_COLUMNS)
    model = quality.fit(quality.learning_rows(docs, read(spark, sf_dir, "labels", LABELS)))
    return quality.good_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Of rows with one id one stays. Rows with a null id and texts without words belong to no group and stay.
    """
    use_small_batches(spark)
    return near_dedup.one_of_each(docs.select(DOCUMENT_COLUMNS), SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    Every row is decided on by itself, those with a null id or of one id too. A null source is a source of its own, a null
    text has no words; a document without words is taken as its place among its source's falls.
    """
    use_small_batches(spark)
    return mixing.mixed_documents(docs.select(DOCUMENT_COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids``: the BPE encoding of every document left; a null or empty text has no ids, a null id stays null."""
    use_small_batches(spark)
    return bpe_codec.encode(docs)


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# SQL can express neither the learned stages nor the encoding; tests/llm/test_pipeline.py tests the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents after all stages, each written and read again; no rows where there are no documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
