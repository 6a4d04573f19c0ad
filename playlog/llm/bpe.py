"""The merges of a BPE vocabulary, and the test whether two tokens can stand side by side.

Merging runs in the order of the merges' ranks. Two neighbouring tokens are *compatible* when merging their joined text
gives exactly these two again, that is, when no merge across their border comes before the merge that takes one of its
two parts away. A sequence of tokens is the encoding of its text exactly if all its neighbours are compatible.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

from playlog.llm.tables import kept

_NEVER = np.int64(1 << 40)


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies.

    Fixed values: printable characters of Latin-1 stand for themselves, the rest follow from 256 on, in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


BYTE_LETTERS = _byte_letters()


class Bpe:
    """A vocabulary file of the tokenizers library with byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {token["content"]: token["id"] for token in stored["added_tokens"]}
        self.longest = max(len(token) for token in self.vocab)
        self.size = max(self.vocab.values()) + 1
        self.letters = {ord(chr(b)): BYTE_LETTERS[b] for b in range(256)}
        left, right, rank = (np.full(self.size, -1, np.int64) for _ in range(3))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for order, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ids = self.vocab[a], self.vocab[b]
            # The suffix ends words only, so it is at the end of the right part and of the merged token.
            merged = self.vocab[a + b]
            self.pairs.setdefault(ids, (order, merged))
            if rank[merged] < 0:
                left[merged], right[merged], rank[merged] = *ids, order
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        by_key = np.argsort(keys)
        self._keys = keys[by_key]
        self._ranks = np.array([order for order, _ in self.pairs.values()], np.int64)[by_key]
        self._merged = np.full(len(model["merges"]), -1, np.int64)
        for order, merged in self.pairs.values():
            self._merged[order] = merged
        self._right_edge = self._edge(right, rank)
        self._left_edge = self._edge(left, rank)
        self.known_fits: dict[int, bool] = {}
        self._lefts: dict[int, list[tuple[int, int]]] = {}
        self._rights: dict[int, list[tuple[int, int]]] = {}

    def _edge(self, part: np.ndarray, rank: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By depth: the parts at one edge of each token, -1 below its base letter, and the ranks that take them away."""
        at, until = np.arange(self.size), np.full(self.size, _NEVER)
        parts, ends = [], []
        while (at >= 0).any():
            parts.append(at)
            ends.append(until)
            until = np.where(at >= 0, rank[at], -1)
            at = np.where(at >= 0, part[at], -1)
        return parts, ends

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of left and right tokens, whether each two may be neighbours."""
        good = np.ones(len(a), bool)
        for lefts, left_ends in zip(*self._right_edge, strict=True):
            for rights, right_ends in zip(*self._left_edge, strict=True):
                live = np.flatnonzero(good & (lefts[a] >= 0) & (rights[b] >= 0))
                if not len(live):
                    break
                x, y = a[live], b[live]
                key = lefts[x] * self.size + rights[y]
                place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
                rank = np.where(self._keys[place] == key, self._ranks[place], _NEVER)
                # Of equal ranks the leftmost merge comes first.
                good[live[(rank < left_ends[x]) & (rank <= right_ends[y]) & (rank < _NEVER)]] = False
        return good

    def fits(self, a: int, b: int) -> bool:
        """``compatible`` for one pair, remembered."""
        key = a * self.size + b
        known = self.known_fits.get(key)
        if known is None:
            if len(self.known_fits) > 1_000_000:
                self.known_fits.clear()
            known = self.known_fits[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        pairs = self.pairs
        rights = self._parts(b, self._left_edge, self._lefts)
        for x, left_end in self._parts(a, self._right_edge, self._rights):
            for y, right_end in rights:
                found = pairs.get((x, y))
                if found and found[0] < left_end and found[0] <= right_end:
                    return False
        return True

    @staticmethod
    def _parts(token: int, edge: tuple[list, list], known: dict[int, list]) -> list[tuple[int, int]]:
        """The parts at an edge of one token, with the ranks that take them away."""
        parts = known.get(token)
        if parts is None:
            parts = known[token] = [
                (int(part[token]), int(end[token])) for part, end in zip(*edge, strict=True) if part[token] >= 0
            ]
        return parts

    def spelled(self, text: str) -> str:
        """A text in the letters of the vocabulary, one for each UTF-8 byte."""
        return text.encode().decode("latin-1").translate(self.letters)

    def _letter_ids(self, spelled: str) -> list[int]:
        ids = [self.vocab[letter] for letter in spelled[:-1]]
        ids.append(self.vocab[spelled[-1] + self.suffix])
        return ids

    def merge(self, spelled: list[str]) -> list[list[int]]:
        """Exact merging of many words, lowest rank first, leftmost first among equals.

        Words of like length are merged together, a step of each at a time; long ones by themselves.
        """
        ids = [self._letter_ids(word) for word in spelled]
        by_size: dict[int, list[int]] = {}
        for word, own in enumerate(ids):
            by_size.setdefault(-(-len(own) // 4) * 4, []).append(word)
        for width, words in by_size.items():
            if width > 48 or len(words) < 4:
                for word in words:
                    ids[word] = self._merge_long(ids[word])
                continue
            table = np.full((len(words), width + 1), -1, np.int64)
            for row, word in enumerate(words):
                table[row, : len(ids[word])] = ids[word]
            for word, own in zip(words, self._merge_table(table), strict=True):
                ids[word] = own
        return ids

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two tokens' merge; later than all where there is none or a token is -1."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[place] == key, self._ranks[place], _NEVER)

    def _merge_table(self, table: np.ndarray) -> list[list[int]]:
        """Merge the words in the rows of a table, which end in -1."""
        done: list[list[int]] = [[] for _ in table]
        rows = np.arange(len(table))
        ranks = self._pair_ranks(table[:, :-1], table[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            over = best >= _NEVER
            if over.any():
                for row, own in zip(rows[over], table[over], strict=True):
                    done[row] = own[own >= 0].tolist()
                rows, table, ranks, at, best = (x[~over] for x in (rows, table, ranks, at, best))
                line = line[: len(rows)]
                if not len(rows):
                    break
            # The merged token takes the left place; what follows the right one moves up.
            source = np.arange(table.shape[1])[None, :] + (np.arange(table.shape[1])[None, :] > at[:, None])
            source[:, -1] = table.shape[1] - 1
            table = np.take_along_axis(table, source, axis=1)
            table[line, at] = self._merged[best]
            ranks = np.take_along_axis(ranks, source[:, :-1].clip(max=ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = _NEVER
            ranks[line, at] = self._pair_ranks(table[line, at], table[line, at + 1])
            left = at > 0
            before = at[left] - 1
            ranks[line[left], before] = self._pair_ranks(table[line[left], before], table[line[left], at[left]])
        return done

    def _merge_long(self, ids: list[int]) -> list[int]:
        """By a queue of ranks and places over a linked list: n log n."""
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        queue = [(found[0], at) for at in range(len(ids) - 1) if (found := self.pairs.get((ids[at], ids[at + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            follower = after[at]
            if ids[at] < 0 or follower < 0:
                continue
            found = self.pairs.get((ids[at], ids[follower]))
            if found is None or found[0] != rank:
                continue
            ids[at], ids[follower] = found[1], -1
            after[at] = after[follower]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0 and (new := self.pairs.get((ids[left], ids[after[left]]))):
                    heapq.heappush(queue, (new[0], left))
        return [token for token in ids if token >= 0]


_loaded: dict[str, Bpe] = kept()


def load(path: str) -> Bpe:
    """The vocabulary of a file, kept for the next task in the same worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
