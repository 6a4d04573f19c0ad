"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams are hashed into buckets, weighted by TF-IDF and scaled to length 1. The model is trained with
follow-the-regularised-leader (FTRL-proximal): each coordinate has its own learning rate, an absolute penalty that keeps
weights at exactly 0 until they are worth it and a squared one, together the elastic net. One temperature, chosen on
learning rows that took no part in training, then turns scores into calibrated probabilities.

Languages and document frequencies are counted over all learning rows. Weights are fitted on a bounded sample that takes
the same number of rows of each language, or all where there are fewer; the rows of a rare language are repeated. Learning rows
are dealt into shards; every shard trains by itself, and the average of the weights is taken by bucket and language in the
executors, from the weights that are not 0. The driver gets one model, however many rows or shards there are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.llm.tables import as_texts, blocks, drawn, release, remainder

UNKNOWN = "und"
# At most about so many learning rows are used; more of them change the model little.
MOST_ROWS = 8_000
SHARDS = 6
BUCKETS = 1 << 15
SIZES = (1, 2, 3)
CALIBRATING = 5  # a learning row out of so many calibrates instead of training
RARE = 50  # a language with fewer rows has none to spare for that
LEAST_ROWS = 1_200  # rows of a language are repeated to about so many
TEMPERATURES = np.geomspace(0.02, 5, 60)

_LETTER = regex.compile(r"\p{L}")
# Odd numbers that spread hashes.
_SPREAD = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)]

PREDICTED = "doc_id bigint, lang_pred string, score double"


@dataclass(frozen=True)
class Ftrl:
    """The parameters of training."""

    alpha: float = 2.0
    beta: float = 1.0
    absolute: float = 0.01
    squared: float = 0.001
    epochs: int = 3


@dataclass
class Model:
    """Languages, inverse document frequencies, a weight per bucket and language, biases, and the temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.langs)))
        for row, text in enumerate(texts):
            at, value = weighted(text, self.idf)
            out[row] = value @ self.weights[at] + self.bias
        return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of a whole text, in lower case, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    rolled = np.zeros(len(codes) + 1, np.uint32)
    for size in SIZES:
        # The hash of the n-grams that start at each place, from that of the shorter ones one place on.
        rolled = (rolled[1 : len(codes) - size + 2] + codes[: len(codes) - size + 1]) * _SPREAD[(size - 1) % 3]
        rolled ^= rolled >> np.uint32(15)
        if not len(rolled):
            break
        counts += np.bincount(rolled & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their TF-IDF weights, of length 1 together."""
    at, counts = grams(text)
    value = (1 + np.log(counts)) * idf[at]
    return at, value / max(np.sqrt(value @ value), 1e-12)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, ftrl: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from rows of buckets, values and the number of the language."""
    z = np.zeros((BUCKETS + 1, n_langs))
    n = np.zeros((BUCKETS + 1, n_langs))

    def current(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - ftrl.absolute, 0)
        return -shrunk / ((ftrl.beta + np.sqrt(n)) / ftrl.alpha + ftrl.squared)

    for _ in range(ftrl.epochs):
        for at, value, lang in rows:
            # The last coordinate is the bias.
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            own_z, own_n = z[at], n[at]
            weights = current(own_z, own_n)
            logits = value @ weights
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[lang] -= 1
            gradient = value[:, None] * error
            squares = gradient * gradient
            z[at] = own_z + gradient - (np.sqrt(own_n + squares) - np.sqrt(own_n)) / ftrl.alpha * weights
            n[at] = own_n + squares
    weights = current(z, n)
    return weights[:-1], weights[-1]


def quotas(counts: dict[str, int], most_rows: int) -> dict[str, int]:
    """How many rows of each language are taken: the same number of all, or all where there are fewer."""
    left, quota = most_rows, {}
    for place, (lang, n) in enumerate(sorted(counts.items(), key=lambda item: (item[1], item[0]))):
        quota[lang] = min(n, left // (len(counts) - place))
        left -= quota[lang]
    return quota


def _summed(rows: DataFrame, work: Callable[[Iterator[tuple[str, object]]], Iterator[tuple[np.ndarray, np.ndarray]]], extra: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and the sums of their values over all partitions; ``work`` gives places and values for the texts of one.

    Only places that occur are shuffled, and one row for each comes to the driver.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (
            pair
            for block in blocks(batches, "text")
            for pair in zip(as_texts(block.column("text")), block.column(extra).to_pylist(), strict=True)
        )
        for place, value in work(texts):
            yield pa.record_batch({"place": pa.array(place, pa.int64()), "value": pa.array(value, pa.float64())})
        release()

    found = rows.select("text", extra).mapInArrow(cells, "place bigint, value double")
    found = found.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    return found["place"].to_numpy(), found["value"].to_numpy()


def _document_counts(texts: Iterator[tuple[str, object]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    counts = np.zeros(BUCKETS + 1)
    for text, _ in texts:
        counts[grams(text)[0]] += 1
        counts[-1] += 1
    place = np.flatnonzero(counts)
    yield place, counts[place]


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """The weight of each bucket by the number of all rows that have it."""
    counts = np.zeros(BUCKETS + 1)
    place, value = _summed(rows, _document_counts, "lang")
    counts[place] = value
    return np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1


def _shard_weights(
    texts: Iterator[tuple[str, object]], numbers: dict[str, int], idf: np.ndarray, ftrl: Ftrl
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = [(*weighted(text, idf), numbers[lang]) for text, lang in texts]
    if rows:
        weights, bias = train(rows, len(numbers), ftrl)
        flat = np.concatenate([weights.ravel(), bias, [1.0]]) * len(rows)
        place = np.flatnonzero(flat)
        yield place, flat[place]


def averaged_weights(rows: DataFrame, langs: Sequence[str], idf: np.ndarray, ftrl: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases, averaged over the models of all partitions by their rows."""
    numbers = {lang: number for number, lang in enumerate(langs)}
    work = functools.partial(_shard_weights, numbers=numbers, idf=idf, ftrl=ftrl)
    flat = np.zeros((BUCKETS + 1) * len(langs) + 1)
    place, value = _summed(rows, work, "lang")
    flat[place] = value
    flat = flat[:-1] / max(flat[-1], 1)
    return flat[: -len(langs)].reshape(BUCKETS, -1), flat[-len(langs) :]


def _losses(texts: Iterator[tuple[str, object]], numbers: dict[str, int], model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    loss = np.zeros(len(TEMPERATURES))
    for text, lang in texts:
        logits = model.logits([text])
        loss -= [np.log(softmax(logits / t)[0, numbers[lang]] + 1e-12) for t in TEMPERATURES]
    yield np.arange(len(loss)), loss


def fit(docs: DataFrame, most_rows: int = MOST_ROWS, ftrl: Ftrl | None = None) -> Model:
    """Learn from ``text`` and ``lang`` of the documents given; rows without either or without a letter are left out.

    All of them count for the languages and the document frequencies. The weights are fitted on at most about
    ``most_rows`` rows, the same number of each language. What comes to the driver has the size of the model.
    """
    ftrl = ftrl or Ftrl()
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    idf = inverse_frequencies(usable)

    quota = quotas(counts, max(most_rows, len(langs)))
    facts = [
        (lang, 1.0 if quota[lang] == counts[lang] else quota[lang] / counts[lang], max(1, LEAST_ROWS // max(1, quota[lang])))
        for lang in langs
    ]
    shares = docs.sparkSession.createDataFrame(facts, "lang string, share double, times int")
    sample = drawn(usable, "doc_id", "drawn").join(F.broadcast(shares), "lang").where("drawn < share")
    # Rows are dealt out by what was drawn for them, so that rows without an id, or of the same, come apart too.
    role = (F.floor(F.col("drawn") * (1 << 29)) % CALIBRATING == 0) & (F.col("times") * RARE <= LEAST_ROWS)
    sample = sample.withColumn("calibrates", role)
    learning = sample.where(~F.col("calibrates")).withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    learning = learning.repartition(SHARDS, F.xxhash64("drawn", "copy")).sortWithinPartitions("drawn", "copy")
    model = Model(langs, idf, *averaged_weights(learning, langs, idf, ftrl))

    work = functools.partial(_losses, numbers={lang: number for number, lang in enumerate(langs)}, model=model)
    place, loss = _summed(sample.where("calibrates"), work, "lang")
    if loss.any():
        model.temperature = float(TEMPERATURES[place[loss.argmin()]])
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        texts = as_texts(block.column("text"))
        real = [bool(model.langs) and bool(_LETTER.search(text)) for text in texts]
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = np.flatnonzero(real)
        if len(rows):
            shares = softmax(model.logits([texts[row] for row in rows]) / model.temperature)
            scores[rows] = shares.max(axis=1)
            for row, best in zip(rows, shares.argmax(axis=1), strict=True):
                langs[row] = model.langs[best]
        yield pa.record_batch(
            {"doc_id": block.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)}
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, a row for each input row.

    ``docs`` has ``doc_id`` and ``text``. A text that is null or has no letter, or any text where nothing was learned, is
    ``und`` with score 0. Equal scores go to the first language in order. A null ``doc_id`` stays null, repeated rows stay
    repeated, an empty table gives an empty one. There is no shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_predict, model=model), PREDICTED)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return remainder(doc_id, 5) == 0


def _keep(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        kept = []
        if batch.num_rows:
            found = pa.Table.from_batches(list(_predict(iter([batch]), model)))
            real = pa.compute.not_equal(found["lang_pred"], UNKNOWN)
            kept = pa.compute.and_(real, pa.compute.greater_equal(found["score"], least)).combine_chunks()
            batch = batch.filter(kept)
        yield batch


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all their columns, whose language is known with a probability of at least ``least``.

    Texts that are null, empty or without a letter go, also with ``least`` 0. Whole texts decide, however long. Rows with a
    null id stay if their text does, repeated rows share their fate, columns of any name are kept, an empty table gives an
    empty one. There is no shuffle.
    """
    return docs.mapInArrow(functools.partial(_keep, model=model, least=least), docs.schema)
