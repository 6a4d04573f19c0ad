from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{k} and" for k in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "b", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, LONG, "en", "a", 2),
    (5, "  \t\n ", "fr", "a", 3),
    (None, "no number here", "en", None, 4),
    (6, "Don't  stop <|endoftext|> I'll\n go é日本😀 Σίσυφος", "en", "c", 5),
    (6, "Don't  stop <|endoftext|> I'll\n go é日本😀 Σίσυφος", "en", "c", 5),
    (7, "1234 !!! ### $$$", None, "c", 6),
    (8, "x", "", "", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty and long texts, repeated rows."""
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with further columns named like results and helpers, in another order."""
    from pyspark.sql import functions as F

    names = ["score", "n_tokens", "size", "key", "_id", "bit", "copies", "steps", "leaf", "rank", "learns", "name", "row"]
    names += ["_bit", "copy", "_copy", "_copies", "_source", "no_source", "part", "n", "key_0", "KEY_1", "drawn"]
    return docs.select(*[F.lit(0).alias(name) for name in names], *reversed(docs.columns))


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    from playlog.llm.tables import documents

    return documents(spark, "/root/testdata/sf0.01")
