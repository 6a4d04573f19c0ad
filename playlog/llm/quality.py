"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from counts of neighbouring kinds of characters and of words
that repeat; a gated attention gives each passage a weight, and the weighted passages together are scored. Only documents
have labels: which passages matter is learned from them.

Learning rows are dealt into shards. In each round every shard goes on from the same parameters over its own rows, and
the parameters are averaged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.llm.tables import as_texts, blocks, bounded_sample, release, remainder

PASSAGE_WORDS = 48
BLOCK_BYTES = 1 << 20  # of text looked at together: it takes a hundred times its size
# At most about so many labelled rows are used.
MOST_ROWS = 10_000
SHARDS = 6
HIDDEN = 16
LEAST_STEPS = 120  # of each shard in a round
THRESHOLD = 0.3

KINDS = 14
# Characters with a kind of their own, or sharing one.
_OWN = {" ": 4, "\n": 5, ".": 6, ",": 6, ";": 6, ":": 6, "!": 7, "?": 7, "|": 8, "\t": 8, "#": 9, "$": 9, "%": 9, "&": 9, "*": 9, "=": 9, "~": 9, "^": 9, "@": 10, "/": 10, "_": 10, "\\": 10, "-": 11, "'": 11, '"': 11, "(": 11, ")": 11, "<": 12, ">": 12, "{": 12, "}": 12, "[": 12, "]": 12}
EXTRA = 6
FEATURES = KINDS * KINDS + EXTRA

SCORED = "doc_id bigint, score double"


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane; the last entry stands for all others."""
    kinds = np.full(0x10001, 13, np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if char in _OWN:
            kinds[code] = _OWN[char]
        elif char.isupper():
            kinds[code] = 1
        elif char.isalpha():
            kinds[code] = 0 if char.islower() else 2
        elif char.isdigit():
            kinds[code] = 3
        elif char.isspace():
            kinds[code] = 4
    return kinds


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The passages of whole texts as rows of features, and the number of each text's first one with the end at last.

    A passage has ``PASSAGE_WORDS`` words, the last one of a text what is left. A text without words is one empty passage.
    """
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[np.minimum(codes, 0x10000)].astype(np.int64)
    ends = np.cumsum([len(text) + 1 for text in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))

    solid = (kinds != 4) & (kinds != 5)
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    # The number of each word in its text, and so the passage each character belongs to.
    first_word = np.searchsorted(begins, np.concatenate([[0], ends]))
    n_words = np.diff(first_word)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bags = np.concatenate([[0], np.cumsum(n_passages)])
    word_owner = owner[begins]
    in_text = np.arange(len(begins)) - first_word[word_owner]
    word_passage = bags[word_owner] + in_text // PASSAGE_WORDS
    passed = np.cumsum(solid & ~np.concatenate([[False], solid[:-1]])) - first_word[owner]
    passage = bags[owner] + np.clip((passed - 1) // PASSAGE_WORDS, 0, n_passages[owner] - 1)

    n = bags[-1]
    same = owner[1:] == owner[:-1]
    pairs = (passage[:-1] * KINDS + kinds[:-1]) * KINDS + kinds[1:]
    counts = np.bincount(pairs[same], minlength=n * KINDS * KINDS).reshape(n, -1)
    letters = np.bincount(passage, minlength=n)

    out = np.zeros((n, FEATURES), np.float32)
    out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(letters, 1)[:, None])
    if len(begins):
        stops = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
        length = stops - begins
        # A hash of each word's characters, which depends on their places in it.
        place = np.arange(len(codes))
        place[begins[0] :] -= np.repeat(begins, np.diff(begins, append=len(codes)))
        mixed = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) + np.uint64(1))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed[~solid] = 0
        words = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), begins)
        order = np.lexsort((np.arange(len(words)), words, word_owner))
        sorted_words, sorted_owner = words[order], word_owner[order]
        again = np.zeros(len(words), bool)
        again[order[1:]] = (sorted_words[1:] == sorted_words[:-1]) & (sorted_owner[1:] == sorted_owner[:-1])
        beside = np.zeros(len(words), bool)
        beside[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
        long = length >= 6
        total = np.maximum(np.bincount(word_passage, minlength=n), 1)
        at = KINDS * KINDS
        out[:, at] = np.bincount(word_passage, again, n) / total
        out[:, at + 1] = np.bincount(word_passage, again & long, n) / np.maximum(np.bincount(word_passage, long, n), 1)
        out[:, at + 2] = np.bincount(word_passage, beside, n) / total
        out[:, at + 3] = np.log1p(np.bincount(word_passage, length, n) / total) / 3
        out[:, at + 4] = np.log1p(total) / 5
        out[:, at + 5] = np.log1p(n_passages[np.repeat(np.arange(len(texts)), n_passages)]) / 8
    return out, bags


@dataclass
class Model:
    """Parameters of the encoder, the gated attention and the score."""

    values: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7) -> Model:
        random = np.random.default_rng(seed)
        draw = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
        return Model(
            {
                "encode": draw(FEATURES, HIDDEN) * 2,
                "encode_bias": np.zeros(HIDDEN),
                "gate_tanh": draw(HIDDEN, HIDDEN),
                "gate_sigmoid": draw(HIDDEN, HIDDEN),
                "attend": draw(HIDDEN, 1) * 0.5,
                "score": draw(HIDDEN, 1),
                "score_bias": np.zeros(1),
            }
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([value.ravel() for value in self.values.values()])

    def with_flat(self, flat: np.ndarray) -> Model:
        values, at = {}, 0
        for name, value in self.values.items():
            values[name] = flat[at : at + value.size].reshape(value.shape)
            at += value.size
        return Model(values)

    def forward(self, rows: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """All intermediate values for bags of passages."""
        v, starts = self.values, bags[:-1]
        hidden = np.tanh(rows @ v["encode"] + v["encode_bias"])
        tanh = np.tanh(hidden @ v["gate_tanh"])
        sigmoid = 1 / (1 + np.exp(-np.clip(hidden @ v["gate_sigmoid"], -30, 30)))
        energy = ((tanh * sigmoid) @ v["attend"])[:, 0]
        owner = np.repeat(np.arange(len(starts)), np.diff(bags))
        share = np.exp(energy - np.maximum.reduceat(energy, starts)[owner])
        share /= np.add.reduceat(share, starts)[owner]
        bag = np.add.reduceat(hidden * share[:, None], starts, axis=0)
        logit = bag @ v["score"][:, 0] + v["score_bias"]
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return {"hidden": hidden, "tanh": tanh, "sigmoid": sigmoid, "share": share, "owner": owner, "bag": bag, "score": score}

    def gradient(self, rows: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The gradient of the mean log loss, in the order of ``flat``."""
        v, f, starts = self.values, self.forward(rows, bags), bags[:-1]
        d_logit = (f["score"] - labels) / len(labels)
        d_bag = d_logit[:, None] * v["score"][:, 0]
        of_row = d_bag[f["owner"]]
        d_share = (of_row * f["hidden"]).sum(axis=1)
        mean = np.add.reduceat(d_share * f["share"], starts)[f["owner"]]
        d_energy = f["share"] * (d_share - mean)
        d_gate = d_energy[:, None] * v["attend"][:, 0]
        d_tanh = d_gate * f["sigmoid"] * (1 - f["tanh"] ** 2)
        d_sigmoid = d_gate * f["tanh"] * f["sigmoid"] * (1 - f["sigmoid"])
        d_hidden = of_row * f["share"][:, None] + d_tanh @ v["gate_tanh"].T + d_sigmoid @ v["gate_sigmoid"].T
        d_in = d_hidden * (1 - f["hidden"] ** 2)
        parts = [
            rows.T @ d_in,
            d_in.sum(axis=0),
            f["hidden"].T @ d_tanh,
            f["hidden"].T @ d_sigmoid,
            (f["tanh"] * f["sigmoid"]).T @ d_energy[:, None],
            f["bag"].T @ d_logit[:, None],
            d_logit.sum(keepdims=True),
        ]
        return np.concatenate([np.ravel(part) for part in parts])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.forward(*passages(texts))["score"]


def train(model: Model, bags: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, seed: int) -> Model:
    """Adam over the bags of one shard, 32 at a time in a random order."""
    random, flat = np.random.default_rng(seed), model.flat().copy()
    # Small shards are gone over more often.
    epochs = max(epochs, LEAST_STEPS * 32 // max(len(bags), 32))
    mean, square, step = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(epochs):
        for own in np.array_split(random.permutation(len(bags)), max(1, len(bags) // 32)):
            rows = np.concatenate([bags[row] for row in own]).astype(np.float64)
            edges = np.concatenate([[0], np.cumsum([len(bags[row]) for row in own])])
            gradient = model.with_flat(flat).gradient(rows, edges, labels[own]) + 1e-5 * flat
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            flat -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model.with_flat(flat)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        rows, bags = passages(as_texts(block.column("text")))
        rows = rows.astype(np.float16)
        own = [rows[a:b].tobytes() for a, b in zip(bags[:-1], bags[1:], strict=True)]
        yield pa.record_batch({"bag": pa.array(own, pa.binary()), "quality": block.column("quality")})
    release()


def _round(batches: Iterator[pa.RecordBatch], model: Model, number: int, epochs: int, rate: float) -> Iterator[pa.RecordBatch]:
    bags: list[np.ndarray] = []
    labels: list[int] = []
    for batch in batches:
        bags += [np.frombuffer(bag, np.float16).reshape(-1, FEATURES) for bag in batch.column("bag").to_pylist()]
        labels += batch.column("quality").to_pylist()
    if bags:
        trained = train(model, bags, np.array(labels, float), epochs, rate, number)
        out = np.concatenate([trained.flat(), [len(bags)]])
        yield pa.record_batch({"out": pa.array([out.tobytes()], pa.binary())})
    del bags
    release()


def fit(labelled: DataFrame, most_rows: int = MOST_ROWS, rounds: int = 5, epochs: int = 4, rate: float = 0.01) -> Model:
    """Learn from ``doc_id, text, quality``; rows whose label is not 0 or 1 are left out, a null text is an empty one.

    At most about ``most_rows`` rows are used, picked by a hash of ``doc_id``. Without any the model stays as it is drawn.
    What comes to the driver are the parameters of each shard.
    """
    usable = labelled.select("doc_id", "text", "quality").where(F.col("quality").isin(0, 1))
    sample = bounded_sample(usable, "doc_id", most_rows)
    dealt = sample.repartition(SHARDS, "doc_id").sortWithinPartitions("doc_id", "text", "quality")
    featured = dealt.select("text", "quality").mapInArrow(_featured, "bag binary, quality int").persist()
    model = Model.fresh()
    try:
        for number in range(rounds):
            step = functools.partial(_round, model=model, number=number, epochs=epochs, rate=rate / (1 + number))
            found = [np.frombuffer(row["out"]) for row in featured.mapInArrow(step, "out binary").collect()]
            if not found:
                break
            shares = np.array([own[-1] for own in found])
            model = model.with_flat(np.average([own[:-1] for own in found], axis=0, weights=shares))
        return model
    finally:
        featured.unpersist()


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        scores = model.scores(as_texts(block.column("text")))
        yield pa.record_batch({"doc_id": block.column("doc_id"), "score": pa.array(scores)})
    release()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text, a row for each input row; the score is the probability of label 1.

    ``docs`` has ``doc_id`` and ``text``. A null text is scored as an empty one, which is one empty passage. A null
    ``doc_id`` stays null, repeated rows stay repeated, an empty table gives an empty one. There is no shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_score, model=model), SCORED)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return remainder(doc_id, 5) == 0


def learning_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, text, quality`` of the labelled documents that are not held out, about ``most_rows`` at most.

    The labels are sampled before the texts are fetched, so that what is broadcast is bounded by ``most_rows``: an id has
    no more than two labels. A document with both is there with each.
    """
    known = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    known = bounded_sample(known.distinct(), "doc_id", most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def _keep(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        yield block.filter(pa.array(model.scores(as_texts(block.column("text"))) >= least))
    release()


def good_documents(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns, that score at least ``least``."""
    return docs.mapInArrow(functools.partial(_keep, model=model, least=least), docs.schema)
