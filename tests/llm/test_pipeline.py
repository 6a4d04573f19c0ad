"""The pipeline as a whole, and each of its stages on what the one before has kept."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_groups import brute_groups
from tokenizers import Tokenizer

import corpus_pipeline
from playlog.llm import mixing
from playlog.llm.tables import DOCUMENT_COLUMNS, documents, stored

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = [documents(spark, SF_DIR)]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF_DIR), f"test-{name}"))
    return docs


def rows_of(frame):
    return Counter(tuple(row) for row in frame.select(DOCUMENT_COLUMNS).collect())


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near-duplicates", "mixing", "bpe"]
    assert all(frame.columns == DOCUMENT_COLUMNS for frame in stages[:-1])
    assert stages[-1].columns == ["doc_id", "ids"]


def test_language_keeps_what_has_one(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    assert not after - before
    gone = before - after
    assert all(not any(letter.isalpha() for letter in text or "") for _, text, *_ in gone)
    assert not [row for row in after if not row[1]]


def test_quality_drops_what_is_labelled_bad(spark, stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    assert not after - before
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {row[0] for row in after}
    good, bad = ([row[0] in kept for row in before if labels.get(row[0]) == quality] for quality in (1, 0))
    # Eleven rows of this table are labelled bad, too few to learn much from; test_learned.py holds the classifier to more.
    assert np.mean(good) >= 0.9 and np.mean(bad) < np.mean(good)


def test_one_document_of_each_group(stages):
    before = [(row["doc_id"], row["text"]) for row in stages[2].collect()]
    groups = brute_groups(before, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT)
    assert sorted(row[0] for row in rows_of(stages[3])) == sorted(set(groups.values()))
    assert not rows_of(stages[3]) - rows_of(stages[2])


def test_mix_takes_its_targets(stages):
    taken = Counter()
    for row in stages[4].collect():
        taken[row["source"]] += len(row["text"].encode().split())
    expected = Counter()
    for row in mixing.mix(stages[3]).collect():
        expected[row["source"]] += row["taken"]
    assert taken == expected
    assert all(n <= 3 for n in Counter(row["doc_id"] for row in stages[4].collect()).values())


def test_ids_are_those_of_the_library(spark, stages):
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = Counter((row["doc_id"], row["text"]) for row in stages[4].collect())
    expected = Counter()
    for (doc_id, text), n in texts.items():
        expected[doc_id, tuple(words.encode(text, add_special_tokens=False).ids)] += n
    for found in (stages[-1], corpus_pipeline.run(spark, SF_DIR)):
        assert Counter((row["doc_id"], tuple(np.frombuffer(row["ids"], "<u4").tolist())) for row in found.collect()) == expected


def test_stages_of_odd_and_no_rows(spark, docs, no_docs):
    for table in (docs, no_docs, docs.withColumn("_bit", F.lit(1)).withColumn("copies", F.lit(2))):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, SF_DIR), f"odd-{name}")
        assert rows.count() <= 3 * table.count()


def test_workers_get_few_bytes_at_once(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(4_000).selectExpr("id AS doc_id", "repeat('long text ', 300) AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
    docs = docs.coalesce(1)
    corpus_pipeline.encode(spark, docs, SF_DIR)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"size": [batch.nbytes]})

    found = [row["size"] for row in docs.select("doc_id", "text").mapInArrow(sizes, "size bigint").collect()]
    assert sum(found) > 10 << 20 and max(found) <= 2 << 20
