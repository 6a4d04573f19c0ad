"""Language, quality and language-model scores: held-out accuracy, exact counts, edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playlog.llm import language_id, lm_scoring, quality
from playlog.llm.queries import op2_lm_scoring, op3_language_id, op4_quality
from playlog.llm.tables import LABELS, read, words_of

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(corpus):
    return language_id.fit(corpus.where(~language_id.held_out(F.col("doc_id"))))


@pytest.fixture(scope="module")
def qualities(spark, corpus):
    return quality.fit(quality.learning_rows(corpus, read(spark, SF_DIR, "labels", LABELS)))


def test_language_of_held_out_documents(spark, corpus):
    found = op3_language_id(spark, SF_DIR).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert {zlib.crc32(str(row["doc_id"]).encode()) % 5 for row in found} == {0}
    assert np.mean([row["lang"] == row["lang_pred"] for row in found]) >= 0.98
    assert all(0 <= row["score"] <= 1 for row in found)


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_languages_of_odd_rows(request, languages, table):
    found = language_id.predict(request.getfixturevalue(table), languages).collect()
    assert len(found) == 10
    for row in found:
        unknown = row["doc_id"] in (2, 3, 5, 7)
        assert (row["lang_pred"] == "und", row["score"] == 0) == (unknown, unknown)
    assert len({tuple(row) for row in found if row["doc_id"] == 6}) == 1


def test_language_filter(docs, no_docs, languages):
    kept = language_id.identified(docs, languages, 0.0)
    assert kept.columns == docs.columns
    assert sorted(row["doc_id"] or 0 for row in kept.collect()) == [0, 1, 4, 6, 6, 8]
    assert language_id.identified(no_docs, languages).count() == 0


def test_language_without_learning(docs, no_docs):
    model = language_id.fit(no_docs)
    assert {(row["lang_pred"], row["score"]) for row in language_id.predict(docs, model).collect()} == {("und", 0.0)}


def test_sparse_weights():
    texts = ["the house and the garden", "das haus und der garten"] * 20
    idf = np.ones(language_id.BUCKETS)
    rows = [(*language_id.weighted(text, idf), k % 2) for k, text in enumerate(texts)]
    weights, _ = language_id.train(rows, 2, language_id.Ftrl(absolute=0.5))
    dense, _ = language_id.train(rows, 2, language_id.Ftrl(absolute=0.0))
    assert 0 < np.count_nonzero(weights) < np.count_nonzero(dense)


def test_grams_count_every_gram():
    text = "Abcab"
    at, counts = language_id.grams(text)
    assert counts.sum() == 5 + 4 + 3
    assert len(at) == len({"a", "b", "c", "ab", "bc", "ca", "abc", "bca", "cab"})


def test_quality_of_held_out_documents(spark):
    labels = read(spark, SF_DIR, "labels", LABELS)
    found = op4_quality(spark, SF_DIR).join(labels, "doc_id").where("held_out").collect()
    good = [row["score"] for row in found if row["quality"] == 1]
    bad = [row["score"] for row in found if row["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) >= 0.95
    assert all(row["predicted"] == (row["score"] >= 0.3) for row in found)


def test_quality_gradient():
    rows, bags = quality.passages(["Hello there World. abc " * 40, "", "x!! y!! Z| " * 40])
    model, labels = quality.Model.fresh(), np.array([1.0, 0.0, 1.0])

    def loss(flat):
        score = model.with_flat(flat).forward(rows.astype(float), bags)["score"]
        return -np.mean(labels * np.log(score) + (1 - labels) * np.log(1 - score))

    flat, gradient = model.flat(), model.gradient(rows.astype(float), bags, labels)
    for place in range(0, len(flat), 97):
        step = np.zeros_like(flat)
        step[place] = 1e-5
        assert math.isclose((loss(flat + step) - loss(flat - step)) / 2e-5, gradient[place], abs_tol=1e-7)


def test_passages_cover_whole_texts():
    rows, bags = quality.passages(["a " * 1000, "", "word", " \n "])
    assert np.diff(bags).tolist() == [-(-1000 // quality.PASSAGE_WORDS), 1, 1, 1]
    assert np.isfinite(rows).all()


def test_attention_finds_the_odd_passage():
    model = quality.Model.fresh()
    share = model.forward(*quality.passages(["a b c " * 200]))["share"]
    assert math.isclose(share.sum(), 1)


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_quality_of_odd_rows(request, qualities, table):
    found = quality.score(request.getfixturevalue(table), qualities).collect()
    assert len(found) == 10
    assert all(0 <= row["score"] <= 1 for row in found)


def test_quality_filter(docs, no_docs, qualities):
    assert quality.good_documents(docs, qualities, 0.0).count() == 10
    assert quality.good_documents(docs, qualities, 1.1).count() == 0
    assert quality.good_documents(no_docs, qualities).count() == 0


def brute_scores(rows):
    tokens = [[*(text or "").encode().lower().split(), b"\n"] for _, text in rows]
    learns = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    counts = Counter(word for own, learn in zip(tokens, learns, strict=True) if learn for word in own)
    total = sum(counts.values())
    room = total + len(counts) + 1
    return [
        (i, len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / room) for w in own))
        for (i, _), own in zip(rows, tokens, strict=True)
    ]


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 5])
def test_base_scores(spark, docs, frequent, monkeypatch):
    """Which words are counted in the tasks and which by a shuffle must not matter."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rows = [(row["doc_id"], row["text"]) for row in docs.collect()]
    found = lm_scoring.score_texts(docs, ~lm_scoring.held_out(F.col("doc_id"))).collect()
    assert len(found) == len(rows)
    expected = sorted(brute_scores(rows), key=repr)
    for got, want in zip(sorted((tuple(row)[:5] for row in found), key=repr), expected, strict=True):
        assert got[:4] == want[:4]
        assert math.isclose(got[4], want[4], rel_tol=1e-9, abs_tol=1e-9)
    assert all(math.isfinite(row["score"]) and row["score"] < 0 for row in found)


def test_scores_beat_word_counts(spark):
    found = [row for row in op2_lm_scoring(spark, SF_DIR).collect() if row["held_out"]]
    assert sum(row["score"] for row in found) > sum(row["base_score"] for row in found)


def test_all_tokens_of_a_shared_bucket_count():
    """After one step the weights of a bucket point where the sum over all its tokens does."""
    import pyarrow as pa

    words = [b"w%d" % k for k in range(lm_scoring.OWN_MEMBERS - 1)]
    text = b" ".join(b"w0 " + words[k % 100 + 1] for k in range(1500))
    batch = pa.record_batch({"text": pa.array([text.decode()])})
    nothing = lm_scoring.Model().member_tokens
    rows = pa.Table.from_batches(list(lm_scoring._train(iter([batch]), words, nothing))).to_pylist()
    vocabulary = lm_scoring.Vocabulary(words)
    tokens = [*text.split(), lm_scoring.END]
    features = lm_scoring.Tokens.of([tokens], vocabulary).features
    after = int(lm_scoring._buckets(features)[0, 1])  # of what follows the first word
    found = next(row for row in rows if row["layer"] == 0 and row["bucket"] == after)
    classes = [vocabulary.member(word) // lm_scoring.MEMBERS for word in tokens[1::2]]
    slope = np.bincount(classes, minlength=lm_scoring.CLASSES) - len(classes) / lm_scoring.CLASSES
    weights = np.array([found[f"w{k}"] for k in range(lm_scoring.CLASSES)])
    assert found["seen"] == 1500
    assert weights @ slope >= 0.999 * np.linalg.norm(weights) * np.linalg.norm(slope)


@pytest.mark.parametrize("most", [1, 7, 60_000])
def test_sums_of_slopes(most):
    random = np.random.default_rng(most)
    buckets = random.integers(0, most, (3, 500))
    slope = random.normal(size=(500, lm_scoring.CLASSES)).astype(np.float32)
    own, times, sums = lm_scoring._summed(buckets, slope)
    assert own.tolist() == sorted(set(buckets.ravel().tolist()))
    assert times.tolist() == [int((buckets == bucket).sum()) for bucket in own]
    plain = [sum(slope[row].astype(float) for each in buckets for row in np.flatnonzero(each == bucket)) for bucket in own]
    assert np.allclose(sums, plain, atol=1e-3)


def test_shares_by_plain_sums():
    """The model's probabilities against sums over single tokens, classes and members."""
    random = np.random.default_rng(3)
    model = lm_scoring.Model(member_tokens=random.integers(0, 50, lm_scoring.CLASSES * lm_scoring.MEMBERS))
    model.class_weights[:] = random.normal(size=model.class_weights.shape)
    model.member_weights[:] = random.normal(size=model.member_weights.shape)
    texts = [[b"the", b"house", b"of", lm_scoring.END], [lm_scoring.END], [b"of", b"the", lm_scoring.END]]
    tokens = lm_scoring.Tokens.of(texts, lm_scoring.Vocabulary([b"the", b"of"]))
    counts = model.member_tokens.reshape(lm_scoring.CLASSES, lm_scoring.MEMBERS) + 1
    expected = []
    for at, member in enumerate(tokens.members.tolist()):
        own, inside = divmod(member, lm_scoring.MEMBERS)
        features = tokens.features[:, at : at + 1]
        total = 0.0
        for weights, buckets, prior, right in (
            (model.class_weights, lm_scoring._buckets(features), counts.sum(axis=1), own),
            (model.member_weights, lm_scoring._member_buckets(features, np.array([own])), counts[own], inside),
        ):
            odds = [n * math.exp(sum(float(weights[bucket][k]) for bucket in buckets[:, 0])) for k, n in enumerate(prior.tolist())]
            total += math.log10(odds[right] / sum(odds))
        expected.append(total)
    assert np.allclose(lm_scoring.log_shares(tokens, model), expected, atol=1e-4)


def test_shares_sum_to_one():
    """Over all members, whatever the words before."""
    vocabulary = lm_scoring.Vocabulary([b"the", b"of"])
    tokens = lm_scoring.Tokens.of([[b"the", b"of", b"house", lm_scoring.END]], vocabulary)
    model = lm_scoring.Model()
    random = np.random.default_rng(0)
    model.class_weights[:] = random.normal(size=model.class_weights.shape)
    model.member_weights[:] = random.normal(size=model.member_weights.shape)
    total = 0
    for member in range(lm_scoring.CLASSES * lm_scoring.MEMBERS):
        tokens.members[:] = member
        total += 10 ** lm_scoring.log_shares(tokens, model)
    assert np.allclose(total, 1, atol=1e-4)


def test_scores_of_an_empty_table(no_docs):
    assert lm_scoring.score_texts(no_docs, F.lit(True)).count() == 0


def test_rare_language(spark):
    """A language with a handful of rows among very many is learned."""
    english, polish = "the quick brown fox and the lazy dog went over hill", "szczęście źdźbło żółć więc będziemy się śmiać często"
    frame = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit(english), F.lit(" "), (F.col("id") % 977).cast("string")).alias("text"),
        F.lit("en").alias("lang"),
    )
    more = spark.createDataFrame([(40_000 + k, f"{polish} {k}", "pl") for k in range(4)], frame.schema)
    model = language_id.fit(frame.union(more))
    asked = spark.createDataFrame([(1, "więc się często śmiać"), (2, "the dog and the fox")], "doc_id bigint, text string")
    found = {row["doc_id"]: row for row in language_id.predict(asked, model).collect()}
    assert (found[1]["lang_pred"], found[2]["lang_pred"]) == ("pl", "en")


def test_quotas():
    assert language_id.quotas({"a": 30_000, "b": 4, "c": 50}, 1_000) == {"b": 4, "c": 50, "a": 946}
    assert language_id.quotas({"a": 10, "b": 10}, 1_000) == {"a": 10, "b": 10}
    assert sum(language_id.quotas({str(k): 999 for k in range(7)}, 1_000).values()) == 1_000


def test_one_model_from_many_partitions(spark, corpus, monkeypatch):
    """However many partitions learn, a row for each weight comes to the driver."""
    monkeypatch.setattr(language_id, "SHARDS", 40)
    sent = []
    original = language_id._summed

    def watched(*args):
        place, value = original(*args)
        sent.append(len(place))
        assert len(set(place.tolist())) == len(place)
        return place, value

    monkeypatch.setattr(language_id, "_summed", watched)
    model = language_id.fit(corpus.repartition(60))
    assert len(sent) == 3 and max(sent) <= (language_id.BUCKETS + 1) * len(model.langs) + 1
    found = language_id.predict(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_sample_of_missing_and_repeated_ids(spark):
    from playlog.llm.tables import bounded_sample

    for key in (F.lit(None).cast("bigint"), F.lit(1).cast("bigint"), F.col("id")):
        rows = spark.range(100_000).select(key.alias("doc_id"), F.lit("x").alias("Drawn"))
        sample = bounded_sample(rows, "doc_id", 8_000)
        assert sample.columns == rows.columns and 7_000 < sample.count() < 9_000


ODD_TEXTS = ["left\tout", None, " A\x0bb  Ä\x85c\x1cD\u3000e ", "", "  ", "one", "one\x0ctwo\r\n", " \ttwo", "É two One"]


def test_words_by_column_are_those_by_text():
    for column in (pa.array(ODD_TEXTS), pa.array(ODD_TEXTS).slice(1), pa.array(ODD_TEXTS).slice(3, 2)):
        words, numbers, sizes = lm_scoring.encoded_words(column)
        expected = [words_of((text or "").encode()) for text in column.to_pylist()]
        assert sizes.tolist() == [len(own) for own in expected]
        assert [words[number] for number in numbers] == [word for own in expected for word in own]
        vocabulary = lm_scoring.Vocabulary([b"two", b"one"])
        one, other = (
            lm_scoring.Tokens.read(column, vocabulary),
            lm_scoring.Tokens.of([[*own, lm_scoring.END] for own in expected], vocabulary),
        )
        for name in ("members", "places", "features", "starts"):
            assert np.array_equal(getattr(one, name), getattr(other, name))


def test_each_word_of_a_block_is_looked_up_once(monkeypatch):
    asked = []
    packed = lm_scoring.Vocabulary.packed
    monkeypatch.setattr(lm_scoring.Vocabulary, "packed", lambda self, words: asked.extend(words) or packed(self, words))
    block = pa.record_batch({"text": ["rare often often"] * 500, "doc_id": [1] * 500, "learns": [True] * 500})
    for rows in (
        lm_scoring._train(iter([block]), [b"often"], np.ones(lm_scoring.CLASSES * lm_scoring.MEMBERS)),
        lm_scoring._others(iter([block]), [b"often"]),
    ):
        asked.clear()
        list(rows)
        assert len(asked) <= 3
