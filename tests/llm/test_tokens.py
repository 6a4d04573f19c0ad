"""Token counts, and encoding and decoding, against the tokenizers library."""

from __future__ import annotations

import copy
import gc
import hashlib
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from playlog.llm import bpe, bpe_codec, mixing, token_counts

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COUNTER = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
CODEC = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json"))

pieces = st.sampled_from(
    ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", " the", "  ", "\n", "\xa0", "\x1c", "Σ", "İ", "é", "é", "日本", "😀"]
)
texts = st.lists(st.one_of(pieces, st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_counts_of_every_prefix(text):
    counts = token_counts.prefix_counts(COUNTER.steps(text))
    assert counts.tolist() == [len(BYTES.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_encoding_and_decoding(text):
    ids = WORDS.encode(text, add_special_tokens=False).ids
    encoded = CODEC.encode([text])[0]
    assert np.frombuffer(encoded, "<u4").tolist() == ids
    assert CODEC.decode(encoded).decode() == WORDS.decode(ids, skip_special_tokens=False)


def test_code_points_of_all_planes():
    """Every code point, assigned in whatever version or not, alone and between letters, in one text a block of 256."""
    for start in range(0, 0x110000, 256):
        points = [chr(k) for k in range(start, start + 256) if not 0xD800 <= k < 0xE000]
        text = " ".join(f"{x} a{x}b :{x} {x}\u0307" for x in points)
        if points and (start < 0x40000 or start % 0x4000 == 0):
            ids = WORDS.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(CODEC.encode([text])[0], "<u4").tolist() == ids, hex(start)
    CODEC.forget()


def test_units_are_remembered_over_many_texts():
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    counter._later = {str(number): b"" for number in range(700_000)}
    counter.all_steps(["some words"])
    assert {"0", "words"} <= counter._later.keys()
    counter._later |= {str(number): b"" for number in range(token_counts.REMEMBERED + 1)}
    counter.all_steps(["some others"])
    assert counter._later.keys() == {"others"}


def test_workers_give_back_what_another_operator_kept():
    path = public_tokenizers.path(bpe_codec.VOCABULARY)
    held = [weakref.ref(bpe_codec.codec(path)), weakref.ref(bpe.load(path))]
    block = pa.record_batch({"text": ["a text"], "source": ["a"]})
    assert next(mixing._sizes(iter([block]))).num_rows == 1
    assert all(ref() is not None for ref in held)
    list(mixing._sizes(iter([block])))
    gc.collect()
    assert not any(path in table for table in (bpe_codec._codecs, bpe._loaded))


def test_pieces_alike_at_their_start():
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["a" * n for n in range(1, 60)] + ["Straße", "Straßen", "straßenbahn", "don't", "don'", "x'''y", "a\nb", "a\n\nb"]
    text = " ".join([*words, *(word + end for word in words for end in (",", "'s", "!!", "ü"))])
    sizes = token_counts.prefix_counts(counter.all_steps([text])[0])
    assert [len(BYTES.encode(text[:end], add_special_tokens=False).ids) for end in range(len(text) + 1)] == sizes.tolist()


def test_long_words():
    text = "ab" * 3000 + "é" * 500 + " " + "a" * 300
    assert np.frombuffer(CODEC.encode([text])[0], "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids
    assert token_counts.prefix_counts(COUNTER.steps(text))[-1] == len(BYTES.encode(text, add_special_tokens=False).ids)


def test_words_that_texts_share_are_kept(monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 2)
    codec = bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.encode(["some words that come again"])
    codec.encode(["words come anew"])
    assert codec.proposed == 6
    assert codec._chunks.keys() == {"words", "come", "anew"}


def test_proposals_are_the_longest_tokens():
    vocab, suffix = CODEC.bpe.vocab, CODEC.bpe.suffix
    asked = []

    class Counted(dict):
        def get(self, token):
            asked.append(token)
            return super().get(token)

    codec = bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.bpe = copy.copy(codec.bpe)
    codec.bpe.vocab = Counted(vocab)
    for word in ["zqxj" * 6, "internationalisation", "a", "thanthlyenin", "ééé", "don't", "ab" * 40]:
        spelled = CODEC.bpe.spelled(word)
        expected, at = [], 0
        while at < len(spelled):
            whole = vocab.get(spelled[at:] + suffix)
            stops = range(len(spelled) - 1, at, -1)
            stop = len(spelled) if whole is not None else next(x for x in stops if spelled[at:x] in vocab)
            expected.append(vocab[spelled[at:stop]] if whole is None else whole)
            at = stop
        asked.clear()
        assert codec.propose(spelled) == expected
    asked.clear()
    codec.propose("zqxj" * 6)
    assert len(asked) <= 4 * 24


def test_only_failing_words_are_merged(corpus):
    codec = bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.encode([row["text"] for row in corpus.select("text").limit(50).collect()])
    assert 0 < codec.failed < codec.proposed


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_rows(request, table):
    rows = request.getfixturevalue(table)
    texts = [(row["doc_id"], row["text"] or "") for row in rows.select("doc_id", "text").collect()]
    counted = token_counts.prefix_token_counts(rows)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "steps"]
    got = sorted(((row[0], row[1], row[2]) for row in counted.collect()), key=repr)
    expected = [(i, len(t.encode()), len(BYTES.encode(t, add_special_tokens=False).ids)) for i, t in texts]
    assert got == sorted(expected, key=repr)

    def digest(text):
        ids = WORDS.encode(text, add_special_tokens=False).ids
        decoded = WORDS.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), decoded.encode())]
        return len(ids), *digests

    got = sorted((tuple(row) for row in bpe_codec.digests(bpe_codec.encode(rows)).collect()), key=repr)
    assert got == sorted(((i, *digest(t)) for i, t in texts), key=repr)


def test_longest_prefix_within_a_budget(docs):
    counted = token_counts.prefix_token_counts(docs)
    fitting = {row["doc_id"]: row["n_fitting"] for row in token_counts.longest_within(counted, 6).collect()}
    for row in docs.where("doc_id IS NOT NULL").collect():
        text = row["text"] or ""
        sizes = [len(BYTES.encode(text[:k], add_special_tokens=False).ids) for k in range(min(len(text), 60) + 1)]
        assert fitting[row["doc_id"]] == max(k for k, n in enumerate(sizes) if n <= 6)
    with pytest.raises(ValueError):
        token_counts.longest_within(counted, -1)


def test_decoded_texts(docs):
    decoded = bpe_codec.decode(bpe_codec.encode(docs)).where("doc_id = 1").first()["decoded"]
    assert decoded.startswith("the</w> quick</w>")


def test_empty(no_docs):
    assert token_counts.prefix_token_counts(no_docs).count() == 0
    assert bpe_codec.digests(bpe_codec.encode(no_docs)).count() == 0


def test_plain_scans(docs):
    for frame in (token_counts.prefix_token_counts(docs), bpe_codec.encode(docs)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
