"""BPE encoding by speculation and verification, and decoding.

For each new word the longest tokens from left to right are proposed. All neighbours of all proposals are then tested
at once for compatibility (see ``bpe``); a proposal whose neighbours all fit is the encoding, and only the words that
fail are merged exactly. Words are remembered, so a text costs a look-up per word.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from playlog.llm import bpe
from playlog.llm.tables import as_texts, blocks, kept, trim

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 250_000
_FIRST = 4  # letters that tell how long a token can be

# The pattern that cuts texts into words for this vocabulary.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_SPACE = regex.compile(r"\p{White_Space}+")
# White space to Python's split, but not to Unicode.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")

# A mark whose place among others differs between versions of Unicode.
_RECLASSED = "\u1df6"
_COMPOSED, _LOWER = normalizers.NFC(), normalizers.Lowercase()
# What stands for a code point that Python doesn't know, by its class. One for private use is in none of them.
_LETTER, _NUMBER, _NO_CLASS = "a", "0", "\ue000"
_CLASSES = [(pre_tokenizers.Split(Regex(p), "removed", invert=True), x) for p, x in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER))]

ENCODED = "doc_id bigint, ids binary"


@functools.lru_cache(1 << 16)
def _known(point: str) -> tuple[str, str]:
    """A code point in lower case, and one of the same class that every version of Unicode knows.

    The libraries know different versions; where Python knows a code point, all of them agree.
    """
    if unicodedata.category(point) != "Cn":
        return point, point
    lower = _LOWER.normalize_str(point)
    return lower, next((x for split, x in _CLASSES if split.pre_tokenize_str(lower)), _NO_CLASS)


def split_words(chunk: str) -> list[str]:
    """The words of a chunk of normalised text without white space."""
    if chunk.isascii() or all(unicodedata.category(point) != "Cn" for point in set(chunk)):
        return _WORDS.findall(chunk)
    points = [_known(point) for point in _COMPOSED.normalize_str(chunk)]
    lower = "".join(point for point, _ in points)
    return [lower[match.start() : match.end()] for match in _WORDS.finditer("".join(stand_in for _, stand_in in points))]


def split_chunks(chunks: list[str]) -> list[list[str]]:
    """``split_words`` of each of many chunks."""
    if any(unicodedata.category(point) == "Cn" for point in set().union(*chunks)):
        return [split_words(chunk) for chunk in chunks]
    return [[chunk] if chunk.isascii() and chunk.isalpha() else _WORDS.findall(chunk) for chunk in chunks]


class Codec:
    """Encoding and decoding with one vocabulary."""

    def __init__(self, path: str) -> None:
        self.bpe = bpe.load(path)
        self._chunks: dict[str, bytes] = {}
        self._special = regex.compile("|".join(map(regex.escape, self.bpe.special)) or r"(?!)")
        self.failed = self.proposed = 0
        self.names: list[str] = [""] * self.bpe.size
        for token, number in (self.bpe.vocab | self.bpe.special).items():
            if number >= len(self.names):
                self.names += [""] * (number + 1 - len(self.names))
            self.names[number] = token

    @functools.cached_property
    def _longest(self) -> dict[str, int]:
        """The longest token that starts with each three letters: no longer one is looked for there."""
        longest: dict[str, int] = {}
        for token in self.bpe.vocab:
            first = token[:_FIRST]
            longest[first] = max(longest.get(first, 0), len(token))
        return longest

    def propose(self, spelled: str) -> list[int]:
        """The longest tokens from left to right; only the last one carries the suffix that ends a word."""
        find, suffix, longest, known = self.bpe.vocab.get, self.bpe.suffix, self.bpe.longest, self._longest.get
        ids, start, end = [], 0, len(spelled)
        last = end - bool(suffix)
        while True:
            token = find(spelled[start:] + suffix) if end - start <= longest else None
            if token is not None:
                ids.append(token)
                return ids
            # A token of fewer letters than these is there for every letter.
            stop = min(last, start + known(spelled[start : start + _FIRST], _FIRST - 1))
            while (token := find(spelled[start:stop])) is None:
                stop -= 1
            ids.append(token)
            start = stop
            if start == end:
                return ids

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: proposed, verified together, merged exactly where a proposal fails."""
        spelled = [self.bpe.spelled(word) for word in words]
        proposals = [self.propose(word) for word in spelled]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, where = np.unique(flat[inner] * self.bpe.size + flat[inner + 1], return_inverse=True)
        good = self.bpe.compatible(keys // self.bpe.size, keys % self.bpe.size)[where]
        failing = np.unique(owner[inner[~good]]).tolist()
        self.failed += len(failing)
        self.proposed += len(words)
        for word, ids in zip(failing, self.bpe.merge([spelled[word] for word in failing]), strict=True):
            proposals[word] = ids
        ends = np.cumsum(np.fromiter(map(len, proposals), np.int64, len(proposals))) * 4
        stored = np.fromiter(chain.from_iterable(proposals), "<u4").tobytes()
        return [stored[start:end] for start, end in pairwise([0, *ends.tolist()])]

    def _learn(self, chunks: set[str]) -> None:
        """Work out chunks of text without white space."""
        if len(self._chunks) > REMEMBERED:
            # What these texts share with others stays.
            self._chunks = {chunk: self._chunks[chunk] for chunk in chunks.intersection(self._chunks)}
        new = list(chunks.difference(self._chunks))
        words = split_chunks(new)
        distinct = list(set(chain.from_iterable(words)))
        ids = dict(zip(distinct, self.words(distinct), strict=True))
        for chunk, own in zip(new, words, strict=True):
            self._chunks[chunk] = ids[own[0]] if len(own) == 1 else b"".join([ids[word] for word in own])

    def forget(self) -> None:
        """Drop what is remembered, so that a worker's next task, which may be another operator's, has the memory."""
        self._chunks.clear()

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at white space: composed, and each letter in lower case by itself."""
        if not text.isascii() and (_RECLASSED in text or not unicodedata.is_normalized("NFC", text)):
            text = _COMPOSED.normalize_str(text)
        # Python writes a sigma at the end of a word in another form; letters here are taken one by one.
        text = text.replace("Σ", "σ").lower()
        return text.split() if not _SEPARATORS.search(text) else [x for x in _SPACE.split(text) if x]

    def parts(self, text: str) -> list[list[str] | int]:
        """Chunks of ordinary text, and the ids of the special tokens between them."""
        out: list[list[str] | int] = []
        start = 0
        for match in self._special.finditer(text) if "<|" in text else ():
            out += [self.chunks(text[start : match.start()]), self.bpe.special[match[0]]]
            start = match.end()
        return [*out, self.chunks(text[start:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.parts(text) for text in texts]
        self._learn({chunk for parts in cut for part in parts if isinstance(part, list) for chunk in part})
        known = self._chunks.__getitem__
        return [
            b"".join(
                b"".join(map(known, part)) if isinstance(part, list) else part.to_bytes(4, "little") for part in parts
            )
            for parts in cut
        ]

    @functools.cached_property
    def _named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All token names in UTF-8, one after the other, with their starts and sizes."""
        names = [name.encode() for name in self.names]
        sizes = np.array([len(name) for name in names])
        return np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, as the vocabulary file decodes them.

        The file names no decoder, so a text is its tokens' names with a space between each two.
        """
        tokens = np.frombuffer(ids, "<u4")
        if not len(tokens):
            return b""
        letters, starts, sizes = self._named
        own = sizes[tokens] + 1
        ends = np.cumsum(own)
        out = np.full(ends[-1], 32, np.uint8)
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = False
        out[inside] = letters[np.repeat(starts[tokens] - (ends - own - np.arange(len(tokens))), own - 1) + np.arange(ends[-1] - len(tokens))]
        return out[:-1].tobytes()


_codecs: dict[str, Codec] = kept()


def codec(path: str) -> Codec:
    """The codec of a vocabulary, kept for the next task in the same worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    own = codec(public_tokenizers.path(vocabulary))
    try:
        for block in blocks(batches, "text"):
            ids = own.encode(as_texts(block.column("text")))
            yield pa.record_batch({"doc_id": block.column("doc_id"), "ids": pa.array(ids, pa.binary())})
    finally:
        own.forget()
        trim()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every text, a row for each input row; ids are little-endian unsigned 32-bit integers.

    ``docs`` has ``doc_id`` and ``text``. A null text counts as an empty one and has no ids. A null ``doc_id`` stays
    null, repeated rows stay repeated, an empty table gives an empty one. There is no shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_encode, vocabulary=vocabulary), ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    own = codec(public_tokenizers.path(vocabulary))
    for batch in batches:
        texts = [None if ids is None else own.decode(ids).decode() for ids in batch.column("ids").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(texts, pa.string())})


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, decoded`` of every row of ids; null ids give a null text."""
    step = functools.partial(_decode, vocabulary=vocabulary)
    return encoded.select("doc_id", "ids").mapInArrow(step, "doc_id bigint, decoded string")


def _digest(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    own = codec(public_tokenizers.path(vocabulary))
    for batch in batches:
        ids = [b"" if own_ids is None else own_ids for own_ids in batch.column("ids").to_pylist()]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(own_ids) // 4 for own_ids in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(own_ids).hexdigest() for own_ids in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(own.decode(own_ids)).hexdigest() for own_ids in ids]),
            }
        )


def digests(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ids; null ids count as none."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_digest, vocabulary=vocabulary), schema)
