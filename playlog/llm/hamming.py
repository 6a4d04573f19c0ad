"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments. Codes within distance ``segments * (r + 1) - 1`` of each other agree in some segment up to
``r`` bits, so looking up all values within ``r`` bits of a query's segments finds them all. The radius ``r`` grows until
the k-th smallest verified distance lies within what is surely covered.

Codes are dealt into blocks, each with its own index; a set of queries is dealt into blocks too, and each two blocks meet
in one task. Equal codes are kept once with their smallest ids, as more could never be among the nearest.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.tables import stored

SEGMENT_BITS = 16
CODES_IN_BLOCK = 16_384
QUERIES_IN_BLOCK = 4_096
FOUND = "query_id bigint, id bigint, distance int"


def sign_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, code``: a bit for each component, 1 where it is above 0, packed into bytes; the last byte is filled with 0.

    ``vectors`` has ``vec_id, embedding``. Rows with a null id, a null or empty vector, or null or non-finite components
    have no code and are left out.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if vec_id is None or not vector.is_valid or vector.values.null_count or not len(vector.values):
                    continue
                values = vector.values.to_numpy(zero_copy_only=False)
                if np.isfinite(values).all():
                    ids.append(vec_id)
                    out.append(np.packbits(values > 0).tobytes())
            yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "code": pa.array(out, pa.binary())})

    return vectors.select("vec_id", "embedding").mapInArrow(codes, "vec_id bigint, code binary")


@functools.cache
def _flips(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    places = itertools.combinations(range(SEGMENT_BITS), radius)
    return np.array([sum(1 << bit for bit in bits) for bits in places], np.int64)


class SegmentIndex:
    """The codes of a block by the value of each of their segments."""

    def __init__(self, codes: np.ndarray) -> None:
        """``codes``: bytes of an even number of columns."""
        self.codes = np.ascontiguousarray(codes)
        self.segments = self.codes.view(">u2").astype(np.int64)
        self.order = [np.argsort(values, kind="stable") for values in self.segments.T]
        edges = np.arange((1 << SEGMENT_BITS) + 1)
        self.starts = [np.searchsorted(self.segments[order, k], edges) for k, order in enumerate(self.order)]

    def _looked_up(self, query: np.ndarray, radius: int) -> np.ndarray:
        found = []
        for k, value in enumerate(query):
            values = value ^ _flips(radius)
            first, last = self.starts[k][values], self.starts[k][values + 1]
            some = last > first
            sizes = last[some] - first[some]
            if len(sizes):
                runs = np.repeat(first[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                found.append(self.order[k][runs])
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def nearest(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of at least all codes that are not farther than the k-th nearest one."""
        query = np.ascontiguousarray(code).view(">u2").astype(np.int64)
        seen = np.zeros(len(self.codes), bool)
        rows, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            looked = self._looked_up(query, radius)
            looked = np.unique(looked[~seen[looked]])
            seen[looked] = True
            rows = np.concatenate([rows, looked])
            own = np.bitwise_count(self.codes[looked] ^ code).sum(axis=1, dtype=np.int64)
            distances = np.concatenate([distances, own])
            covered = len(query) * (radius + 1) - 1
            if len(rows) == len(self.codes):
                break
            if len(rows) >= k:
                kth = np.partition(distances, k - 1)[k - 1]
                near = distances <= kth
                rows, distances = rows[near], distances[near]
                if kth <= covered:
                    break
        return rows, distances


def _search(codes: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    own, asked = codes.column("code").to_pylist(), queries.column("code").to_pylist()
    ids = codes.column("ids").to_pylist()
    query_ids = queries.column("vec_id").to_pylist()
    # Only codes of the same length are compared.
    for size in {len(code) for code in asked} & {len(code) for code in own}:
        rows = [row for row, code in enumerate(own) if len(code) == size]
        padded = size + size % 2
        table = np.zeros((len(rows), padded), np.uint8)
        table[:, :size] = np.frombuffer(b"".join(own[row] for row in rows), np.uint8).reshape(-1, size)
        index = SegmentIndex(table)
        for query_id, code in zip(query_ids, asked, strict=True):
            if len(code) != size:
                continue
            # One more code than asked for: the query itself may be among the found.
            found, distances = index.nearest(np.frombuffer(code.ljust(padded, b"\0"), np.uint8), k + 1)
            best = sorted((d, i) for row, d in zip(found, distances, strict=True) for i in ids[rows[row]] if i != query_id)
            for distance, vec_id in best[:k]:
                out[0].append(query_id)
                out[1].append(vec_id)
                out[2].append(int(distance))
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.int32())})


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, distance``: each query's ``k`` nearest other rows by Hamming distance, ties to smaller ids.

    Both frames have ``vec_id, code``. Null ids and null or empty codes take no part; a query has fewer results where
    there are fewer codes of its length. Repeated rows of codes count once; a query given twice is answered once. Empty
    tables give an empty result.
    """
    real = F.col("vec_id").isNotNull() & (F.length("code") > 0)
    asked = queries.where(real).select("vec_id", "code").distinct()
    # Of equal codes the k + 1 smallest ids are enough, the query itself among them. They are kept small on the way: by
    # a part of the rows first, then over the parts.
    parts = codes.where(real).select("vec_id", "code", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("salt"))
    least = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    distinct = parts.groupBy("code", "salt").agg(least.alias("ids")).groupBy("code")
    distinct = distinct.agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    )
    distinct = stored(distinct, "hamming-codes")
    n_blocks = max(1, -(-distinct.count() // CODES_IN_BLOCK))
    n_queries = max(1, -(-asked.count() // QUERIES_IN_BLOCK))

    def dealt(frame: DataFrame, key: str, own: str, n: int, other: str, n_other: int) -> DataFrame:
        return frame.withColumns(
            {
                own: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))),
            }
        )

    left = dealt(distinct, "code", "block", n_blocks, "asked", n_queries)
    right = dealt(asked, "vec_id", "asked", n_queries, "block", n_blocks)
    search = functools.partial(_search, k=k)
    found = (
        left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked")).applyInArrow(search, schema=FOUND)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return (
        found.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "distance")
    )
