"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix's encoding is the one token that ends there and is compatible with the last token of the
shorter prefix before it, so the count of a prefix is the count of that shorter prefix plus one. This gives the counts
of all prefixes of a piece in one pass over it. Texts are cut where the vocabulary's pattern surely cuts them, before a
single space between two other characters; pieces are worked out once and remembered, so a text costs a look-up per
word. Counts are kept as steps: the change of the count with each code point.
"""

from __future__ import annotations

import array
import functools
import itertools
import operator
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from playlog.llm import bpe
from playlog.llm.tables import as_texts, blocks, kept

VOCABULARY = "byte_bpe_50k.json"
# What a worker remembers at most, some 200 and 300 bytes each. Of the units of 20 MB of text not half are there again in
# the next 20 MB, so forgetting them too soon means to work most of a text out anew.
REMEMBERED = 1_200_000  # units
REMEMBERED_PIECES = 600_000
# Bytes of text worked on at once: the more new pieces are learned together, the more of their prefixes they share.
BLOCK_BYTES = 8 << 20

# The pattern that cuts texts for byte-level vocabularies. White space is meant as Unicode defines it.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, steps binary"


SHARED = 24  # letters by which neighbours are compared


def _shared(ordered: list[str]) -> list[int]:
    """How many letters each text has in common with the one before it, of the first ``SHARED``; no two are the same."""
    if not ordered:
        return []
    letters = np.array([text[:SHARED] for text in ordered], f"U{SHARED}").view(np.uint32).reshape(-1, SHARED)
    differs = letters[1:] != letters[:-1]
    return [0, *np.where(differs.any(axis=1), differs.argmax(axis=1), SHARED).tolist()]


def _steps(counts: list[int]) -> bytes:
    """The changes of counts, as 16-bit integers."""
    return array.array("h", map(operator.sub, counts[1:], counts)).tobytes()


def _contracted(piece: str) -> bool:
    return piece[0] == "'" and len(piece) == 3


class PrefixCounter:
    """Counts of all prefixes, for one vocabulary."""

    def __init__(self, path: str) -> None:
        self.bpe = bpe.load(path)
        self._pieces: dict[str, bytes] = {}
        self._tokens = ahocorasick.Automaton()
        for token, number in self.bpe.vocab.items():
            shorter = sum(token[start:] in self.bpe.vocab for start in range(len(token)))
            self._tokens.add_word(token, (len(token), number, shorter))
        self._tokens.make_automaton()
        self._first: dict[str, bytes | None] = {}
        self._later: dict[str, bytes | None] = {}
        self._special = regex.compile("|".join(map(regex.escape, self.bpe.special)) or r"(?!)")

    def piece(self, piece: str) -> bytes:
        """The steps of a piece that the pattern keeps whole."""
        if piece not in self._pieces:
            self._learn_pieces([piece])
        return self._pieces[piece]

    def _learn_pieces(self, pieces: Iterable[str]) -> None:
        """Count all prefixes of pieces that are new: at each end, the tokens that end there are tried, longest first.

        In order, a piece shares most of its prefixes with the one before; only those after them are worked out.
        """
        if len(self._pieces) > REMEMBERED_PIECES:
            self._pieces.clear()
        fits, size, known_fit, ending = self.bpe.fits, self.bpe.size, self.bpe.known_fits.get, self._tokens.iter
        ordered = sorted((self.bpe.spelled(piece), piece) for piece in pieces if piece not in self._pieces)
        # By length of the prefix: its last token, its count, and how many tokens end in it at all.
        last, counts, seen = [-1], [0], [0]
        for (spelled, piece), same in zip(ordered, _shared([spelled for spelled, _ in ordered]), strict=True):
            del last[same + 1 :], counts[same + 1 :], seen[same + 1 :]
            at = done = same - 1
            for end, (length, token, shorter) in itertools.islice(ending(spelled), seen[same], None):
                if end == done:
                    continue
                if end != at:
                    seen.append(seen[at + 1] + shorter)
                    at = end
                start = end + 1 - length
                if start:
                    fit = known_fit(last[start] * size + token)
                    if fit is False or (fit is None and not fits(last[start], token)):
                        continue
                last.append(token)
                counts.append(counts[start] + 1)
                done = end
            if len(spelled) == len(piece):
                own = counts
            else:
                own = [0, *(counts[end] for end in itertools.accumulate(len(x.encode()) for x in piece))]
            self._pieces[piece] = _steps(own)

    def total(self, text: str) -> int:
        return sum(sum(array.array("h", self.piece(piece))) for piece in _PIECES.findall(text))

    def unit(self, text: str, pieces: list[str] | None = None) -> bytes:
        """The steps of a text without special tokens, as 16-bit integers."""
        pieces = _PIECES.findall(text) if pieces is None else pieces
        if "'" not in text and text[1:].split() == [text[1:]]:
            return b"".join(map(self.piece, pieces))
        own = [self.piece(piece) for piece in pieces]
        # A prefix that ends right after the second of two white spaces, or inside a contraction, is cut in another
        # way than the whole text: its count is worked out from the start of the piece before.
        other = [place for place, piece in enumerate(pieces) if (place and piece[0].isspace()) or _contracted(piece)]
        counts = [0, *itertools.accumulate(array.array("h", b"".join(own)))]
        starts = [0, *itertools.accumulate(map(len, pieces))]
        held = [counts[start] for start in starts]
        for place in other:
            before = max(place - 1, 0)
            end = starts[place] + (1 if place and pieces[place][0].isspace() else 2)
            counts[end] = held[before] + self.total(text[starts[before] : end])
        return _steps(counts)

    def _learn(self, first: set[str], later: set[str]) -> None:
        """Work out new units: the texts between single spaces, and with the space before them if they are not first."""
        cut: list[tuple[dict, str, str, list[str]]] = []
        for known, lead, units in ((self._first, "", first), (self._later, " ", later)):
            if len(known) > REMEMBERED:
                known.clear()
            whole = []
            for unit in units:
                if unit in known:
                    continue
                # White space at an end belongs together with the space beside it: such texts are worked out whole.
                if unit and not unit[0].isspace() and not unit[-1].isspace():
                    whole.append(unit)
                else:
                    known[unit] = None
            if lead:
                # All are cut at once, as they are in a text: a piece with a space before it is the first of its unit.
                pieces = _PIECES.findall("".join([lead + unit for unit in whole]))
                starts = [place for place, piece in enumerate(pieces) if piece[0] == lead]
                own = [pieces[start:end] for start, end in itertools.pairwise([*starts, len(pieces)])]
            else:
                own = [_PIECES.findall(unit) for unit in whole]
            cut += [(known, unit, lead + unit, parts) for unit, parts in zip(whole, own, strict=True)]
        self._learn_pieces({piece for *_, parts in cut for piece in parts})
        for known, unit, text, parts in cut:
            if len(parts) == 1 and "'" not in text:
                known[unit] = self._pieces[text]
            else:
                known[unit] = self.unit(text, parts)

    def _plain(self, text: str) -> bytes:
        """The steps of a text without special tokens."""
        units = text.split(" ")
        try:
            return self._first[units[0]] + b"".join(map(self._later.__getitem__, units[1:]))
        except KeyError:
            self._learn({units[0]}, set(units[1:]))
            return self._plain(text)
        except TypeError:
            return self.unit(text)

    def all_steps(self, texts: list[str]) -> list[bytes]:
        """The steps of many texts; what is new in them is worked out together first."""
        first: set[str] = set()
        later: set[str] = set()
        for text in texts:
            units = text.split(" ")
            first.add(units[0])
            later.update(units[1:])
        self._learn(first, later)
        return [self.steps(text) for text in texts]

    def steps(self, text: str) -> bytes:
        """The steps of a text; special tokens inside it count as one each."""
        if not text:
            return b""
        found = list(self._special.finditer(text)) if self.bpe.special else []
        if not found:
            return self._plain(text)
        out, start = [], 0
        for match in found:
            plain = text[start : match.start()]
            out.append(self._plain(plain) if plain else b"")
            # Cut inside its letters, a special token is ordinary text that belongs to what stands before it.
            tail = _PIECES.findall(plain)[-1] if plain else ""
            held = self.total(tail)
            counts = [held, *(self.total(tail + match[0][:n]) for n in range(1, len(match[0]))), held + 1]
            out.append(np.diff(counts).astype("<i2").tobytes())
            start = match.end()
        out.append(self._plain(text[start:]) if start < len(text) else b"")
        return b"".join(out)


def prefix_counts(steps: bytes) -> np.ndarray:
    """The token counts of all prefixes, the empty one first, from stored steps."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)])


_counters: dict[str, PrefixCounter] = kept()


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary, kept for the next task in the same worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    own = counter(public_tokenizers.path(vocabulary))
    for block in blocks(batches, "text", BLOCK_BYTES):
        texts = as_texts(block.column("text"))
        steps = own.all_steps(texts)
        yield pa.record_batch(
            {
                "doc_id": block.column("doc_id"),
                "n_bytes": pa.array([len(text.encode()) for text in texts], pa.int64()),
                "n_tokens": pa.array([int(np.frombuffer(s, "<i2").sum(dtype=np.int64)) for s in steps], pa.int64()),
                "steps": pa.array(steps, pa.binary()),
            }
        )


def prefix_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, steps`` of every text, a row for each input row.

    ``docs`` has ``doc_id`` and ``text``. A null text counts as an empty one: no bytes, no tokens, empty steps. A null
    ``doc_id`` stays null, repeated rows stay repeated, an empty table gives an empty one. There is no shuffle: a row's
    work depends on its own text only.
    """
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_count, vocabulary=vocabulary), COUNTS)


def _fit(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fitting = [
            None if steps is None else int(np.flatnonzero(prefix_counts(steps) <= budget)[-1])
            for steps in batch.column("steps").to_pylist()
        ]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_fitting": pa.array(fitting, pa.int64())})


def longest_within(counted: DataFrame, budget: int) -> DataFrame:
    """``doc_id, n_fitting``: the length in code points of each text's longest prefix of at most ``budget`` tokens.

    Read off the stored steps; nothing is encoded again. Steps that are null give null.
    """
    if budget < 0:
        raise ValueError("a budget of tokens is 0 or more")
    fit = functools.partial(_fit, budget=budget)
    return counted.select("doc_id", "steps").mapInArrow(fit, "doc_id bigint, n_fitting bigint")
