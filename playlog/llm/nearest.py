"""Approximate nearest vectors by a hierarchical k-means tree.

The tree is fitted on a bounded sample: k-means divides the vectors of a node among its children until a node is small.
Every vector then belongs to a leaf. A query walks the tree best bin first: a priority queue holds the branches not taken
by their distance, and the nearest one is always taken next. How many leaves a query visits is calibrated: for some
queries the true neighbours are found by brute force, and visits are widened until the asked share of them is reached.
Inside the visited leaves distances are exact.

A query visits its nearest leaves first. The distance of the last of the nearest found there bounds what may still come: of the other
leaves only those are visited whose ball around the centre reaches within the bound, and only rows within it are given out. So
what a query sends on is of the order of the neighbours asked for, however many leaves it visits.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.tables import bounded_sample, stored

SAMPLE = 16_000  # vectors that the tree is fitted on, at most about
BRANCHES = 8
LEAF_ROWS = 512  # about what a leaf should hold, as long as there are few enough leaves
MOST_LEAVES = 8_192
BLOCK_ROWS = 4_096  # of a leaf that are worked on in one task
BLOCK_QUERIES = 4_096  # that are worked on with them
FIRST_ROWS = 1_024  # that the leaves visited first should hold
CALIBRATING = 96  # queries
RECALL = 0.95

FOUND = "query_id bigint, id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, not zero, and has no null or non-finite component."""
    infinite = F.lit(float("inf"))

    def finite(x: Column) -> Column:
        return F.coalesce(F.abs(x) < infinite, F.lit(False))

    good = F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances between two sets of rows, by products: fast, and exact enough to choose a branch."""
    return (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)


@dataclass
class Tree:
    """Nodes with the centres of their children; a child below 0 is leaf ``-child - 1``."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    n_leaves: int = 0
    middles: list[np.ndarray] = field(default_factory=list)

    def grow(self, rows: np.ndarray, leaf_rows: float, random: np.random.Generator) -> int:
        """Add the subtree of these rows and return its number, as ``children`` has it."""
        groups = self._divided(rows, random) if len(rows) > max(leaf_rows, 1) and self.n_leaves < MOST_LEAVES else None
        if groups is None:
            self.n_leaves += 1
            self.middles.append(rows.mean(axis=0))
            return -self.n_leaves
        node = len(self.centres)
        centres, owner = groups
        self.centres.append(centres)
        self.children.append(np.zeros(len(centres), np.int64))
        for child in range(len(centres)):
            self.children[node][child] = self.grow(rows[owner == child], leaf_rows, random)
        return node

    @staticmethod
    def _divided(rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
        """Centres and the child of each row by k-means; none where all rows are equal."""
        centres = rows[random.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
        centres = np.unique(centres, axis=0)
        owner = squared(rows, centres).argmin(axis=1)
        for _ in range(8):
            sizes = np.bincount(owner, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, owner, rows)
            centres = sums[sizes > 0] / sizes[sizes > 0][:, None]
            owner = squared(rows, centres).argmin(axis=1)
        present, owner = np.unique(owner, return_inverse=True)
        return (centres[present], owner) if len(present) > 1 else None

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: always down to the nearest child."""
        out = np.zeros(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))] if self.centres else []
        while waiting:
            node, own = waiting.pop()
            best = squared(rows[own], self.centres[node]).argmin(axis=1)
            for child in np.unique(best):
                number, there = int(self.children[node][child]), own[best == child]
                if number < 0:
                    out[there] = -number - 1
                else:
                    waiting.append((number, there))
        return out

    def spread(self, rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The distance of each row from the middle of its leaf."""
        if not self.middles:
            return np.zeros(len(rows))
        return np.sqrt(((rows - np.array(self.middles)[leaves]) ** 2).sum(axis=1))

    def best_first(self, row: np.ndarray) -> Iterator[int]:
        """The leaves for a query, nearest branch first."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -node - 1
                continue
            distances = squared(row[None, :], self.centres[node])[0]
            for distance, child in zip(distances.tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (distance, child))


def fit_tree(sample: np.ndarray, n_rows: int, seed: int = 3) -> Tree:
    """A tree for a table of ``n_rows`` vectors from a sample of them."""
    tree = Tree()
    if len(sample):
        leaf_rows = max(LEAF_ROWS, n_rows / MOST_LEAVES * 4) * len(sample) / max(n_rows, 1)
        tree.grow(sample, leaf_rows, np.random.default_rng(seed))
    return tree


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances in double precision."""
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def nearest_rows(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``k`` nearest rows with other ids, ties to smaller ids, each id once."""
    far = distances(rows, query)
    far[ids == query_id] = np.inf
    if len(far) > 4 * k:
        near = np.flatnonzero(far <= np.partition(far, 2 * k)[2 * k])
    else:
        near = np.arange(len(far))
    near = near[np.lexsort((ids[near], far[near]))]
    near = near[np.isfinite(far[near])]
    _, first = np.unique(ids[near], return_index=True)
    if len(first) < len(near) and len(first) < k < len(rows) and len(near) < len(rows):
        # Rows of one id took the places: look at all.
        near = np.lexsort((ids, far))
        near = near[np.isfinite(far[near])]
        _, first = np.unique(ids[near], return_index=True)
    near = near[np.sort(first)][:k]
    return ids[near], far[near]


def _brute(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, np.ndarray]], tree: Tree, k: int) -> Iterator[pa.RecordBatch]:
    """The nearest of each partition for a few queries, with their leaves."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, ids = rows_of(batch.column("embedding")), batch.column("vec_id").to_numpy()
        leaf = dict(zip(ids.tolist(), tree.leaves(rows).tolist(), strict=True))
        found = [(query_id, *nearest_rows(rows, ids, query, query_id, k)) for query_id, query in queries]
        near = np.concatenate([own for _, own, _ in found])
        yield pa.record_batch(
            {
                "query_id": pa.array(np.repeat([query_id for query_id, *_ in found], [len(own) for _, own, _ in found])),
                "id": pa.array(near),
                "score": pa.array(np.concatenate([far for *_, far in found])),
                "leaf": pa.array([leaf[own] for own in near.tolist()], pa.int64()),
            }
        )


def _leafed(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = rows_of(batch.column("embedding"))
        leaves = tree.leaves(rows)
        columns = {name: batch.column(name) for name in ("vec_id", "embedding")}
        yield pa.record_batch(columns | {"leaf": pa.array(leaves), "far": pa.array(tree.spread(rows, leaves))})


@dataclass(frozen=True)
class Leaves:
    """How many rows each leaf holds, and how far from its middle they reach."""

    sizes: dict[int, int]
    radii: dict[int, float]

    def first(self, order: Iterator[int], k: int) -> Iterator[int]:
        """The leaves a query visits first: until they hold enough rows."""
        held = 0
        for leaf in order:
            yield leaf
            held += self.sizes.get(leaf, 0)
            # The query itself is in a leaf, too.
            if held > max(k, FIRST_ROWS):
                return


def _first_visits(batches: Iterator[pa.RecordBatch], tree: Tree, leaves: Leaves, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        visits = [
            (row, leaf) for row, query in enumerate(rows_of(batch.column("embedding"))) for leaf in leaves.first(tree.best_first(query), k)
        ]
        yield _visiting(batch, visits, np.full(batch.num_rows, np.inf))


def _more_visits(batches: Iterator[pa.RecordBatch], tree: Tree, leaves: Leaves, visits: int, k: int) -> Iterator[pa.RecordBatch]:
    """The other leaves each query visits, without those that hold nothing within its bound."""
    for batch in batches:
        bounds, found = batch.column("bound").to_numpy(zero_copy_only=False), []
        for row, query in enumerate(rows_of(batch.column("embedding"))):
            done = set(leaves.first(tree.best_first(query), k))
            for number, leaf in enumerate(tree.best_first(query)):
                if number >= visits:
                    break
                if leaf in done or leaf not in leaves.sizes:
                    continue
                nearest = np.sqrt(((query - tree.middles[leaf]) ** 2).sum()) - leaves.radii[leaf]
                # A hair wider than the bound, as distances are rounded.
                if nearest <= bounds[row] * (1 + 1e-9):
                    found.append((row, leaf))
        yield _visiting(batch, found, bounds)


def _visiting(batch: pa.RecordBatch, visits: list[tuple[int, int]], bounds: np.ndarray) -> pa.RecordBatch:
    at = np.array([row for row, _ in visits], np.int64)
    picked = batch.select(["vec_id", "embedding"]).take(pa.array(at))
    return pa.record_batch(
        {
            "leaf": pa.array([leaf for _, leaf in visits], pa.int64()),
            "query_id": picked.column("vec_id"),
            "query": picked.column("embedding"),
            "bound": pa.array(bounds[at]),
        }
    )


VISITS = "leaf bigint, query_id bigint, query array<float>, bound double"


def searched(leafed: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: the nearest rows within its bound that each query finds in the leaves it visits.

    Many rows of a leaf are dealt into blocks, and so are many queries that visit it; each pair of blocks is a task's work.
    """
    visits = stored(visits, "nearest-visits")
    of_rows = leafed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    of_queries = visits.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    # A row per leaf, of which there are few more than MOST_LEAVES.
    blocks = F.broadcast(stored(of_rows.join(of_queries, "leaf"), "nearest-blocks"))

    def dealt(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("bigint")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))

    left = leafed.join(blocks, "leaf").withColumn("part", dealt("vec_id", "row_blocks")).withColumn("block", every("query_blocks"))
    right = visits.join(blocks, "leaf").withColumn("block", dealt("query_id", "query_blocks")).withColumn("part", every("row_blocks"))
    keys = ["leaf", "part", "block"]
    left = left.select(*keys, "vec_id", "embedding").groupBy(*keys)
    right = right.select(*keys, "query_id", "query", "bound").groupBy(*keys)
    return left.cogroup(right).applyInArrow(functools.partial(_search, k=k), schema=FOUND)


def _search(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        own, ids = rows_of(rows.column("embedding").combine_chunks()), rows.column("vec_id").to_numpy()
        asked = rows_of(queries.column("query").combine_chunks())
        bounds = queries.column("bound").to_numpy()
        for query_id, query, bound in zip(queries.column("query_id").to_pylist(), asked, bounds, strict=True):
            near, far = nearest_rows(own, ids, query, query_id, k)
            near, far = near[far <= bound], far[far <= bound]
            out.append((np.full(len(near), query_id), near, far))
    columns = [np.concatenate([x[part] for x in out]) if out else [] for part in range(3)]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(("query_id", "id", "score"), columns, kinds, strict=True)})


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest other rows found, by Euclidean distance.

    Both frames have ``vec_id, embedding``. Rows with a null id, or a vector that is null, empty, zero, or has null or
    non-finite components, take no part; neither do vectors of another length than most. Ties go to smaller ids. An id
    counts once, with its nearest row; a query given twice is answered once. Where there are fewer than ``k`` other ids,
    all are found. Empty tables give an empty result.

    The tree is fitted on about ``SAMPLE`` rows at most and every row is put into a leaf. What comes to the driver are that
    sample, the calibrating queries with their neighbours, and the sizes of the leaves, of which there are few more than
    ``MOST_LEAVES``. A leaf that holds many rows is dealt into blocks.
    """
    rows, asked = usable(vectors), usable(queries)
    n_rows = rows.count()
    taken = bounded_sample(rows, "vec_id", SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    lengths = pa.compute.list_value_length(taken).to_numpy(zero_copy_only=False)
    width = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    rows, asked = (frame.where(F.size("embedding") == width) for frame in (rows, asked))
    asked = asked.dropDuplicates(["vec_id"])
    sample = rows_of(taken.filter(pa.array(lengths == width)))
    tree = fit_tree(np.unique(sample, axis=0) if len(sample) else sample, n_rows)
    schema = "vec_id bigint, embedding array<float>, leaf bigint, far double"
    leafed = stored(rows.mapInArrow(functools.partial(_leafed, tree=tree), schema), "nearest-leaves")
    held = leafed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    leaves = Leaves({row["leaf"]: row["n"] for row in held}, {row["leaf"]: row["radius"] for row in held})

    some = bounded_sample(asked, "vec_id", CALIBRATING).toArrow()
    some_rows = rows_of(some.column("embedding").combine_chunks())
    few = list(zip(some.column("vec_id").to_pylist(), some_rows, strict=True))
    by_query = Window.partitionBy("query_id").orderBy("score", "id")
    visits = 1
    if few and n_rows:
        brute = functools.partial(_brute, queries=few, tree=tree, k=k)
        true = rows.mapInArrow(brute, f"{FOUND}, leaf bigint").withColumn("rank", F.row_number().over(by_query))
        needed = []
        order = {query_id: {leaf: n for n, leaf in enumerate(tree.best_first(row), 1)} for query_id, row in few}
        for row in true.where(F.col("rank") <= k).collect():
            needed.append(order[row["query_id"]][row["leaf"]])
        needed.sort()
        # So many visits that the asked share of the true neighbours lies in the visited leaves.
        visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1

    ranked = F.row_number().over(by_query)
    first = asked.mapInArrow(functools.partial(_first_visits, tree=tree, leaves=leaves, k=k), VISITS)
    first = searched(leafed, first, k).groupBy("query_id", "id").agg(F.min("score").alias("score"))
    first = stored(first.withColumn("rank", ranked).where(F.col("rank") <= k), "nearest-first")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = bounded.mapInArrow(functools.partial(_more_visits, tree=tree, leaves=leaves, visits=visits, k=k), VISITS)
    found = first.drop("rank").unionByName(searched(leafed, more, k))
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    found = found.withColumn("rank", ranked).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
