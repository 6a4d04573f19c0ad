"""Spelling variants of the words of a corpus: words that differ by one edit, found by bit-sliced position indexes.

The vocabulary is counted in the tasks. Two words differ by one edit only if, with the edit in one half of the shorter
word, the other half is intact. So a word goes to a group for each half that may be intact, and meets only the words that
share it, once as long as they are and once one letter longer. A group that is too large is dealt out again by the same
rule: the edit lies in one half of what is left, the other half joins what must be intact. At the end one letter is
left, where a group has no more members than there are letters, so no group, however many words begin alike, is large.

Inside a block of groups, words are bits. For each position and letter of what is left of the words a bitset tells which
words have that letter there. All words of a block are read letter by letter at once: one set holds the words that equal
what was read (no error so far), one those with another letter somewhere (one error, same positions), one those with a
letter more (one error, positions shifted by one). Each step is a few ANDs and ORs of whole words of bits.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.llm.tables import as_texts, blocks, stored

# What is a run of letters, the least length and number of words, and which runs lose a letter.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 7
LEAST_OCCURRENCES = 2
DROPS = 31
FORM_FACTOR = 10

_LONG_RUN = re.compile(f"{RUN[:-1]}{{{LEAST_LETTERS},}}")
_LOWER = {letter: letter + 32 for letter in range(65, 91)}

REMEMBERED = 200_000  # words a task counts before it gives them out
LARGE_GROUP = 512  # words from which on a group is dealt out again
LONG_REST = 32  # letters of a rest from which on it is halved again
BLOCK_ROWS = 512

WORDS = "word string, n bigint"
MEMBERS = "base int, low int, high int, intact string, word string, n bigint"
PAIRS = "word string, n bigint, near string, near_n bigint"


def counted_word(doc_id: int | None, run: str) -> str:
    """What a lower-cased run of a document counts as: one in 31, told by a checksum, has lost a letter."""
    checksum = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if checksum % DROPS:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for block in blocks(batches, "text"):
        for doc_id, text in zip(block.column("doc_id").to_pylist(), as_texts(block.column("text")), strict=True):
            # A run shorter than a word can't count as one.
            for run, n in Counter(run.translate(_LOWER) for run in _LONG_RUN.findall(text)).items():
                word = counted_word(doc_id, run)
                if len(word) >= LEAST_LETTERS:
                    counts[word] += n
            if len(counts) > REMEMBERED:
                yield out()
                counts.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the distinct words of at least 7 letters that occur at least twice in all whole texts."""
    counted = docs.select("doc_id", "text").mapInArrow(_count, WORDS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_OCCURRENCES)


def _halves(rows: DataFrame) -> DataFrame:
    """Members of groups, each in the two groups its own is dealt out to: with the edit in the left or the right half.

    A group has words of ``base`` letters, and of one more; what may differ are the letters from ``low`` to before
    ``high``, one more in the longer words, and ``intact`` are all others.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    longer = F.length("word") - F.col("base")
    halves = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))
    )
    dealt = rows.select("base", "word", "n", longer.alias("longer"), F.explode(halves).alias("half")).where("half.low < half.high")
    low, high = F.col("half.low"), F.col("half.high")
    after = high + F.col("longer")
    # A letter that no word has stands for what was cut out.
    intact = F.concat(
        F.substring("word", F.lit(1), low), F.lit(" "), F.substring("word", after + 1, F.length("word"))
    )
    return dealt.select("base", low.alias("low"), high.alias("high"), intact.alias("intact"), "word", "n")


def groups(words: DataFrame) -> DataFrame:
    """``base, low, high, intact, word, n``: the groups of words in which all pairs of one edit meet, none of them large."""
    bases = F.explode(F.array(F.length("word"), F.length("word") - 1))
    whole = words.select(bases.alias("base"), F.lit(0).alias("low"), F.lit("").alias("intact"), "word", "n")
    members = _halves(whole.withColumn("high", F.col("base")))
    keys = ["base", "low", "high", "intact"]
    done = None
    while True:
        members = stored(members, "spellings-members")
        sizes = members.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
        divides = (F.col("high") - F.col("low") > 1) & (
            (F.col("size") > LARGE_GROUP) | (F.col("high") - F.col("low") > LONG_REST)
        )
        sizes = stored(sizes.withColumn("divides", divides), "spellings-sizes")
        small = members.join(sizes.where("NOT divides").drop("size", "divides"), keys, "left_semi")
        done = small if done is None else done.unionByName(small)
        large = sizes.where("divides").drop("size", "divides")
        if large.isEmpty():
            return done
        members = _halves(members.join(large, keys, "left_semi"))


def _bits(rows: np.ndarray, columns: np.ndarray, n_rows: int, n: int) -> np.ndarray:
    """A bitset of ``n`` words for each row, with the given bits set."""
    out = np.zeros((n_rows, -(-n // 64)), np.uint64)
    np.bitwise_or.at(out, (rows, columns >> 6), np.uint64(1) << (columns & 63).astype(np.uint64))
    return out


def one_edit_apart(group: np.ndarray, rests: list[str], longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group whose rests differ by one edit.

    Rests of a group have the same length, but for the longer ones, which have one letter more. The first row of a pair
    is not a longer one; pairs of rows that are both not longer come both ways round.
    """
    n = len(rests)
    lengths = np.array([len(rest) for rest in rests], np.int64)
    letters = np.zeros((n, int(lengths.max(initial=0)) + 1), np.int64)
    for row, rest in enumerate(rests):
        letters[row, : len(rest)] = np.frombuffer(rest.encode("utf-32-le"), np.uint32)
    # The index: a bitset for each position and letter that occur. Past the end of a word there is no letter.
    own, place = np.nonzero(letters)
    cells, cell = np.unique(place << 21 | letters[own, place], return_inverse=True)
    index = np.concatenate([_bits(cell, own, len(cells), n), np.zeros((1, -(-n // 64)), np.uint64)])

    queries = np.flatnonzero(~longer)
    _, number = np.unique(group, return_inverse=True)
    of_group = _bits(number, np.arange(n), int(number.max(initial=0)) + 1, n)[number[queries]]
    are_longer = _bits(np.zeros(int(longer.sum()), np.int64), np.flatnonzero(longer), 1, n)[0]

    def having(position: int, letter: np.ndarray) -> np.ndarray:
        """The words that have a letter at a position, for each query's letter."""
        wanted = position << 21 | letter
        at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
        return index[np.where(cells[at] == wanted, at, len(cells))]

    equal = of_group.copy()
    other, shifted = np.zeros_like(equal), np.zeros_like(equal)
    for position in range(int(lengths[queries].max(initial=0))):
        letter = letters[queries, position]
        reads = letter > 0
        here, after = having(position, letter), having(position + 1, letter)
        new_other = (other & here) | (equal & ~here)
        new_shifted = (shifted | equal) & after
        new_equal = equal & here
        other = np.where(reads[:, None], new_other, other)
        shifted = np.where(reads[:, None], new_shifted, shifted)
        equal = np.where(reads[:, None], new_equal, equal)
    # Words that equal all that was read have their further letter at the end. A word of one more letter was also read
    # as one with another letter; only words as long as the query count there.
    found = (other & ~are_longer) | ((shifted | equal) & are_longer)
    if not found.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little", count=n)
    at, near = np.nonzero(bits)
    return queries[at], near


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of one edit, both ways round, in rows sorted by group."""

    def found(rows: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        words, counts = rows["word"].to_pylist(), rows["n"].to_numpy()
        low, high, base = (rows[name].to_numpy() for name in ("low", "high", "base"))
        longer = np.array([len(word) for word in words]) > base
        rests = [word[a : b + more] for word, a, b, more in zip(words, low, high, longer.astype(int), strict=True)]
        one, other = one_edit_apart(number, rests, longer)
        back = longer[other]
        left, right = np.concatenate([one, other[back]]), np.concatenate([other, one[back]])
        return pa.record_batch(
            {
                "word": pa.array([words[row] for row in left], pa.string()),
                "n": pa.array(counts[left], pa.int64()),
                "near": pa.array([words[row] for row in right], pa.string()),
                "near_n": pa.array(counts[right], pa.int64()),
            }
        )

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        keys = [held[name].to_numpy() for name in ("base", "low", "high")]
        intact = np.array(held["intact"].to_pylist(), object)
        new = np.ones(held.num_rows, bool)
        new[1:] = (intact[1:] != intact[:-1]) | np.any([key[1:] != key[:-1] for key in keys], axis=0)
        number, starts = np.cumsum(new), np.flatnonzero(new)
        start = 0
        # The last group may go on in the next batch.
        for end in starts[1:]:
            if end - start >= BLOCK_ROWS or end == starts[-1]:
                yield found(held.slice(start, end - start), number[start:end])
                start = end
        held = held.slice(start)
        last = number[start:]
    if held is not None:
        yield found(held, last)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words that differ by exactly one edit, both ways round."""
    keys = ["base", "low", "high", "intact"]
    dealt = groups(words).repartition(*keys).sortWithinPartitions(*keys)
    # A letter doubled can be dropped at several places, so that a pair may be found in several groups.
    return dealt.mapInArrow(_pairs, PAIRS).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word in ``word, form``: where its forms lead.

    A form occurs at least ten times as often as its word, so a way is short; in each round it is halved.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")), "spellings-ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moves"))
        moved = stored(moved, "spellings-ways")
        ways = moved.drop("moves")
        if moved.where("moves").isEmpty():
            return ways


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, n, form, form_n, n_near, root``, a row for each word of the vocabulary.

    ``docs`` has ``doc_id`` and ``text``. Runs of letters of whole texts have A-Z lower-cased; a run whose checksum with
    the id of its document is a multiple of 31 loses a letter, a null id counting as empty text there. Words have at least
    7 letters and 2 occurrences. ``n_near`` counts the words one inserted, deleted or replaced letter away, ``form`` is
    the one of them with the largest count (of several the first in order of code points) if that is at least ten times
    the word's own, else null, and ``root`` is reached by following forms, the word itself if it has none. Null and empty
    texts have no words, repeated rows count again, an empty table gives an empty one.
    """
    words = stored(vocabulary(docs), "spellings-words")
    near = near_words(words).groupBy("word").agg(
        F.first("n").alias("n"),
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"),
    )
    takes = -F.col("best.rank") >= FORM_FACTOR * F.col("n")
    near = near.select(
        "word",
        "n_near",
        F.when(takes, F.col("best.form")).alias("form"),
        F.when(takes, -F.col("best.rank")).alias("form_n"),
    )
    near = stored(near, "spellings-near")
    found = roots(near.where(F.col("form").isNotNull()))
    return (
        words.join(near, "word", "left")
        .join(found, "word", "left")
        .select(
            "word",
            "n",
            "form",
            "form_n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.coalesce("root", "word").alias("root"),
        )
    )
