"""Secrets in texts: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Three patterns find what is written as a secret: a value assigned to a telling name, an access key, a long run of
hexadecimal digits. They also label the samples that two character models learn from: what the patterns take is random,
what is too short for a secret is ordinary. Each model knows how likely a character is after the one before.
A run that no pattern took is a secret too if the random model gives it more than the ordinary one by a factor large
enough, both for the run as a whole and on average for a character: the log-likelihood ratio.

Transitions are counted over all texts in the tasks and summed by pair of characters, so a model has the same size
however many texts there are. Values are counted once each, as a copied text would else fill the model of random strings.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.llm.tables import as_texts, blocks, stored

# The patterns, their least lengths, and the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(ACCESS)
# A run is taken whole from its first digit, so asking for its length finds the same runs.
_HEX = re.compile(f"{HEX[:-1]}{{{LEAST_HEX},}}")

LEAST_RUN = 20
LEAST_RATIO = 10.0  # in nats, for the run
LEAST_MEAN = 0.5  # in nats, for a character
LEAST_SYMBOLS = 8  # different ones in a run: a ruled line is not random
PRIOR = 50.0
CHUNK = 1 << 20  # symbols counted at once

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
SYMBOLS = len(_ALPHABET) + 1  # 0 is what is in no run
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(letter) for letter in _ALPHABET]] = np.arange(1, SYMBOLS)

SAMPLES = "cell int, n bigint, value string"
FOUND = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint,ratio:double>>"


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """Start, end and number of the kind of all that the patterns find, in order; and the values found."""
    spans, values = [], []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        for match in _ASSIGN.finditer(text):
            if len(match[2]) >= LEAST_VALUE:
                spans.append((match.start(), match.end(), 0))
                values.append(match[2])
    for kind, pattern, least in ((1, _ACCESS, LEAST_ACCESS), (2, _HEX, LEAST_HEX)):
        for match in pattern.finditer(text):
            if match.end() - match.start() >= least:
                spans.append((match.start(), match.end(), kind))
                values.append(match[0])
    return sorted(spans, key=lambda span: (span[0], span[2])), values


def symbols_of(text: str) -> np.ndarray:
    """The number of each code point's symbol."""
    return _SYMBOL[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def transitions(symbols: np.ndarray, before: int = 0) -> np.ndarray:
    """The cell of each symbol and the one before it."""
    shifted = np.concatenate([np.array([before], np.uint8), symbols[:-1]])[: len(symbols)]
    return shifted.astype(np.int64) * SYMBOLS + symbols


def count_transitions(symbols: np.ndarray) -> np.ndarray:
    """How often each cell occurs inside runs."""
    counts = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for start in range(0, len(symbols), CHUNK):
        own = symbols[start : start + CHUNK]
        cells = transitions(own, int(symbols[start - 1]) if start else 0)
        counts += np.bincount(cells[own > 0], minlength=len(counts))
    return counts


@dataclass(frozen=True)
class Model:
    """For each cell, by how much the random model gives the symbol more than the ordinary one, as a logarithm."""

    ratios: np.ndarray | None

    def random_runs(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """Start, end and ratio of the runs outside of what is taken that are random."""
        if self.ratios is None:
            return []
        found, at = [], 0
        for match in _RUN.finditer(text):
            start, end = match.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            # Spans come by start: if this one begins later, all others do.
            if at < len(taken) and taken[at][0] < end:
                continue
            if len(set(match[0])) < LEAST_SYMBOLS:
                continue
            ratio = float(self.ratios[transitions(symbols_of(match[0]))].sum())
            if ratio >= max(LEAST_RATIO, LEAST_MEAN * (end - start)):
                found.append((start, end, ratio))
        return found


def logarithms(counts: np.ndarray) -> np.ndarray:
    """How likely each symbol is after each other: by counts of the pair, and as many more as ``PRIOR``, dealt out by how
    often the symbol occurs at all."""
    table = counts.reshape(SYMBOLS, SYMBOLS)[:, 1:].astype(np.float64)
    alone = (table.sum(axis=0) + 1) / (table.sum() + SYMBOLS - 1)
    logs = np.zeros((SYMBOLS, SYMBOLS))
    logs[:, 1:] = np.log((table + PRIOR * alone) / (table.sum(axis=1, keepdims=True) + PRIOR))
    return logs.ravel()


def model_of(random: np.ndarray, ordinary: np.ndarray) -> Model:
    """The model from the counts of both classes; none where one of them has no samples."""
    if not random.any() or not ordinary.any():
        return Model(None)
    return Model(logarithms(random) - logarithms(ordinary))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordinary = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for block in blocks(batches, "text"):
        values: set[str] = set()
        for text in as_texts(block.column("text")):
            spans, own = base_spans(text)
            values.update(own)
            symbols = symbols_of(text)
            # Of a long run it is not known yet what it is.
            for start, end in [span[:2] for span in spans] + [match.span() for match in _RUN.finditer(text)]:
                symbols[start:end] = 0
            ordinary += count_transitions(symbols)
        if values:
            yield pa.record_batch({"cell": pa.nulls(len(values), pa.int32()), "n": pa.nulls(len(values), pa.int64()), "value": pa.array(sorted(values))})
    cells = np.flatnonzero(ordinary)
    yield pa.record_batch({"cell": pa.array(cells.astype(np.int32)), "n": pa.array(ordinary[cells]), "value": pa.nulls(len(cells), pa.string())})


def labelled_samples(docs: DataFrame) -> DataFrame:
    """``cell, n, value``: values that the patterns take, and transitions of all runs too short to be one, from whole texts."""
    return docs.select("text").mapInArrow(_samples, SAMPLES)


def _value_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        for value in batch.column("value").to_pylist():
            random += count_transitions(symbols_of(value))
    cells = np.flatnonzero(random)
    yield pa.record_batch({"cell": pa.array(cells.astype(np.int32)), "n": pa.array(random[cells])})


def fit(samples: DataFrame) -> Model:
    """The model from samples: a row for each pair of symbols comes to the driver, a few thousand at most."""
    samples = stored(samples, "secret-samples")
    values = samples.where(F.col("value").isNotNull()).select("value").distinct()
    counts = []
    for cells in (values.mapInArrow(_value_cells, "cell int, n bigint"), samples.where(F.col("cell").isNotNull()).select("cell", "n")):
        own = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
            own[row["cell"]] = row["n"]
        counts.append(own)
    return model_of(*counts)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def _spans(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        rows = []
        for doc_id, text in zip(block.column("doc_id").to_pylist(), as_texts(block.column("text")), strict=True):
            base, _ = base_spans(text)
            more = model.random_runs(text, base)
            ratios = {(start, end, 3): ratio for start, end, ratio in more}
            spans = sorted([*base, *ratios], key=lambda span: (span[0], span[2]))
            rows.append(
                {
                    "doc_id": doc_id,
                    **{f"n_{name}": sum(kind == number for *_, kind in base) for number, name in enumerate(KINDS[:3])},
                    "base_sha256": hashlib.sha256(_named(base).encode()).hexdigest(),
                    "spans": _named(spans),
                    "found": [
                        {"kind": KINDS[kind], "start": start, "end": end, "ratio": ratios.get((start, end, kind))}
                        for start, end, kind in spans
                    ],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        *[(f"n_{name}", pa.int64()) for name in KINDS[:3]],
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        (
            "found",
            pa.list_(
                pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])
            ),
        ),
    ]
)


def find_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``, a row for each input row.

    ``docs`` has ``doc_id`` and ``text``. The patterns are matched from left to right without overlaps, each kind by
    itself, over the whole text; matches that are too short are dropped. ``n_`` counts those of a kind; ``base_sha256`` is
    the digest of ``kind:start:end`` of all of them by start, joined by commas, in code points with the end exclusive.
    ``spans`` joins them with what the model adds as ``random``, and ``found`` has the same as rows, with the
    log-likelihood ratio of those added. A null or empty text has none; a null ``doc_id`` stays null, repeated rows stay
    repeated, an empty table gives an empty one. Without a model nothing is added.
    """
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_spans, model=model), FOUND)
