"""Secrets, against the patterns applied one by one, and the character models on strings made for them."""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playlog.llm import secret_spans

NAME = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    """The contract's patterns as they stand."""
    found = [("assign", m.start(), m.end()) for m in NAME.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(found, key=lambda x: (x[1], order[x[0]]))


def named(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


pieces = st.sampled_from(
    ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "API-key", "=", ":", " = ", "'", '"', "  ", "AKIA", "ABCDEFGH0123456789",
     "0123456789abcdef", "deadbeef", "x.y/z+w=_-", "hunter2hunter2", "é", "ſecret", "toKen", "K", "İ", "😀", "\n", "token=secret=abcdefghijkl", "word"]
)


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=14))
def test_patterns(parts):
    text = "".join(parts)
    spans, values = secret_spans.base_spans(text)
    assert [(secret_spans.KINDS[kind], start, end) for start, end, kind in spans] == brute_base(text)
    assert len(values) == len(spans)


def test_counts_of_transitions():
    text = "ab abéA" * 3
    counts = secret_spans.count_transitions(secret_spans.symbols_of(text)).reshape(secret_spans.SYMBOLS, -1)
    a, b, capital = (secret_spans._ALPHABET.index(letter) + 1 for letter in "abA")
    assert counts[0, a] == 4 and counts[a, b] == 6 and counts[0, capital] == 3 and counts[capital, a] == 2
    assert counts.sum() == 15
    whole = np.tile(secret_spans.symbols_of(text), 9)
    expected = secret_spans.count_transitions(whole)
    old, secret_spans.CHUNK = secret_spans.CHUNK, 7
    try:
        assert (secret_spans.count_transitions(whole) == expected).all()
    finally:
        secret_spans.CHUNK = old


def made(draw, letters, n):
    return "".join(draw.choice(letters) for _ in range(n))


WORDS = "user profile settings default value request handler account number the of and service update status table index".split()


@pytest.fixture(scope="module")
def planted(spark):
    """Ordinary texts, some with secrets that the patterns find, some with secrets that only look random."""
    draw = random.Random(8)
    letters = string.ascii_letters + string.digits
    rows, hidden = [], {}
    for k in range(300):
        text = " ".join(draw.choice(WORDS) for _ in range(40)) + " " + "_".join(draw.choice(WORDS) for _ in range(4))
        if k % 5 == 0:
            text += f" password: '{made(draw, letters, 30)}' and AKIA{made(draw, string.ascii_uppercase + string.digits, 16)}"
        if k % 7 == 0:
            secret = made(draw, letters, 36)
            hidden[k] = (len(text) + 6, len(text) + 6 + 36)
            text += f" key ({secret}) there"
        rows.append((k, text + " é end"))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows), hidden


def test_random_strings_are_found_and_words_left(planted):
    docs, texts, hidden = planted
    model = secret_spans.fit(secret_spans.labelled_samples(docs))
    for row in secret_spans.find_secrets(docs, model).collect():
        base = brute_base(texts[row["doc_id"]])
        added = [(found["start"], found["end"]) for found in row["found"] if found["kind"] == "random"]
        assert added == ([hidden[row["doc_id"]]] if row["doc_id"] in hidden else [])
        assert row["base_sha256"] == hashlib.sha256(named(base).encode()).hexdigest()
        spans = sorted([*base, *(("random", *span) for span in added)], key=lambda x: x[1])
        assert row["spans"] == named(spans)
        assert [row[f"n_{kind}"] for kind in ("assign", "access", "hex")] == [
            sum(x[0] == kind for x in base) for kind in ("assign", "access", "hex")
        ]
        assert all((found["ratio"] is None) == (found["kind"] != "random") for found in row["found"])


def test_copied_values_count_once(spark, planted):
    docs, _, _ = planted
    one = secret_spans.fit(secret_spans.labelled_samples(docs))
    copies = docs.where("doc_id = 0").crossJoin(spark.range(50)).select("doc_id", "text")
    many = secret_spans.fit(secret_spans.labelled_samples(docs.union(copies)))
    strings = ["q7Zx81LmPqR0sTvW93xY", "user_profile_settings"]
    for text in strings:
        ratios = [model.ratios[secret_spans.transitions(secret_spans.symbols_of(text))].sum() for model in (one, many)]
        assert (ratios[0] > 20) == (ratios[1] > 20) == (text == strings[0])


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_odd_rows(request, table):
    rows = request.getfixturevalue(table)
    model = secret_spans.fit(secret_spans.labelled_samples(rows))
    found = secret_spans.find_secrets(rows, model).collect()
    assert len(found) == 10 and model.ratios is None
    assert all(row["spans"] == "" and row["base_sha256"] == hashlib.sha256(b"").hexdigest() for row in found)


def test_long_runs_and_no_documents(spark, no_docs):
    model = secret_spans.fit(secret_spans.labelled_samples(no_docs))
    assert model.ratios is None and secret_spans.find_secrets(no_docs, model).count() == 0
    text = "token=" + "ab" * 500_000 + " " + "0f" * 500_000 + " plain words"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    model = secret_spans.fit(secret_spans.labelled_samples(docs))
    row = secret_spans.find_secrets(docs, model).first()
    assert row["spans"] == "assign:0:1000006,hex:6:1000006,hex:1000007:2000007"
