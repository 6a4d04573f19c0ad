"""Centroid clustering of whole-number vectors by bit planes.

Each component is turned into a whole number, and plane ``i`` of a vector holds bit ``i`` of its 64 components, packed into
one 64-bit word. In two's complement a component is the sum of its bits times ``2 ** i``, the bit of the last plane
counting negative, so the dot product of two vectors is the sum over all pairs of planes of the weighted number of bits
that both have set: an AND and a popcount for 64 components at once. Squared lengths, distances and, by counts of the
bits of each component, sums of vectors come from the planes as well, and all of them are exact.

Vectors are packed once and stay as planes. A round sends the centroids to the tasks, and each task gives the sums of
its own vectors, one row per centroid: nothing that grows with the vectors is shuffled or comes to the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm.tables import stored

COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
# Whole numbers stay within these ends, so that a squared distance, and sums of many, fit 64 bits.
MOST = 1 << 26
BLOCK_ROWS = 2_048

PACKED = "vec_id bigint, first string, planes binary"
SUMS = "cluster int, n bigint, sums array<bigint>"
ASSIGNED = "vec_id bigint, cluster int, distance bigint"


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """``floor(256 * x)`` of each component as double, held within the ends."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def pack(numbers: np.ndarray) -> np.ndarray:
    """The planes of vectors, a row of 64-bit words each: as many planes as the largest component needs, and its sign."""
    least, most = int(numbers.min(initial=0)), int(numbers.max(initial=0))
    n_planes = max(most.bit_length(), (~min(least, -1)).bit_length()) + 1
    bits = (numbers[:, None, :] >> np.arange(n_planes)[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def widen(planes: np.ndarray, n_planes: int) -> np.ndarray:
    """The same vectors with more planes: those added repeat the sign."""
    more = n_planes - planes.shape[1]
    return planes if more <= 0 else np.concatenate([planes, np.repeat(planes[:, -1:], more, axis=1)], axis=1)


def weights_of(n_planes: int) -> np.ndarray:
    """What a bit counts in each plane."""
    weights = np.left_shift(np.int64(1), np.arange(n_planes, dtype=np.int64))
    weights[-1] = -weights[-1]
    return weights


def dot(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The dot products of all vectors of two sets, given as planes."""
    out = np.zeros((len(one), len(other)), np.int64)
    weights, weights_other = weights_of(one.shape[1]), weights_of(other.shape[1])
    for i, weight in enumerate(weights):
        for j, weight_other in enumerate(weights_other):
            both = np.bitwise_count(one[:, i, None] & other[None, :, j])
            out += both.astype(np.int64) * (weight * weight_other)
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """The squared length of each vector."""
    weights = weights_of(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for i, weight in enumerate(weights):
        for j, weight_other in enumerate(weights):
            out += np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64) * (weight * weight_other)
    return out


def sum_of(planes: np.ndarray) -> np.ndarray:
    """The sum of vectors, by component: how many have each bit, times what it counts."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return weights_of(planes.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


@dataclass(frozen=True)
class Centroids:
    """Centroids as whole numbers, numbered by their row."""

    numbers: np.ndarray

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the first of several, and its squared distance."""
        own = pack(self.numbers)
        distances = squares(planes)[:, None] + squares(own)[None, :] - 2 * dot(planes, own)
        best = distances.argmin(axis=1)
        return best, distances[np.arange(len(planes)), best]


def _pack(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.slice(start, BLOCK_ROWS)
            values = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
            planes = pack(whole_numbers(values))
            ids = rows.column("vec_id").to_pylist()
            hashes = [None if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
            packed = [own.tobytes() for own in planes.astype("<u8")]
            yield pa.record_batch({"vec_id": rows.column("vec_id"), "first": pa.array(hashes, pa.string()), "planes": pa.array(packed, pa.binary())})


def packed_vectors(vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """``vec_id, first, planes`` of the vectors with exactly 64 components, none of them null or non-finite.

    ``first`` is the hash by which starting centroids are picked; null for a null id.
    """
    # None that is null, not a number, or beyond the largest finite value.
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = vectors.where((F.size("embedding") == COMPONENTS) & ~wrong)
    rows = usable.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(functools.partial(_pack, seed=seed), PACKED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their planes, as wide as the widest among them."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.slice(start, BLOCK_ROWS)
            own = [np.frombuffer(planes, "<u8")[None, :] for planes in rows.column("planes").to_pylist()]
            width = max(planes.shape[1] for planes in own)
            yield rows, np.concatenate([widen(planes, width) for planes in own])


def _summed(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    n, sums = np.zeros(len(centroids.numbers), np.int64), np.zeros(centroids.numbers.shape, np.int64)
    for _, planes in _blocks(batches):
        clusters, _ = centroids.nearest(planes)
        n += np.bincount(clusters, minlength=len(n))
        for cluster in np.unique(clusters):
            sums[cluster] += sum_of(planes[clusters == cluster])
    found = np.flatnonzero(n)
    yield pa.record_batch(
        {
            "cluster": pa.array(found.astype(np.int32)),
            "n": pa.array(n[found]),
            "sums": pa.array(sums[found].tolist(), pa.list_(pa.int64())),
        }
    )


def _assigned(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    for rows, planes in _blocks(batches):
        clusters, distances = centroids.nearest(planes)
        yield pa.record_batch(
            {
                "vec_id": rows.column("vec_id"),
                "cluster": pa.array(clusters.astype(np.int32)),
                "distance": pa.array(distances),
            }
        )


def starting_centroids(packed: DataFrame, k: int) -> Centroids:
    """The ``k`` vectors whose ids have the smallest hashes, in their order; rows of one id by their planes, null ids last."""
    rows = packed.orderBy(F.asc_nulls_last("first"), "planes").limit(k).select("planes").collect()
    planes = [np.frombuffer(row["planes"], "<u8")[None, :] for row in rows]
    return Centroids(np.array([sum_of(own) for own in planes], np.int64).reshape(-1, COMPONENTS))


def moved(packed: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after a round: each the floor of the mean of its vectors; one without vectors stays."""
    found = packed.select("planes").mapInArrow(functools.partial(_summed, centroids=centroids), SUMS)
    sums = [F.sum(F.element_at("sums", place + 1)).alias(f"s{place}") for place in range(COMPONENTS)]
    numbers = centroids.numbers.copy()
    for row in found.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        numbers[row["cluster"]] = [row[f"s{place}"] // row["n"] for place in range(COMPONENTS)]
    return Centroids(numbers)


def _digest(numbers: Column) -> Column:
    return F.sha2(F.array_join(numbers, ","), 256)


def _long(number: int) -> int | None:
    return number if -(1 << 63) <= number < 1 << 63 else None


def centroid_table(spark: SparkSession, centroids: Centroids, inertias: dict[int, int]) -> DataFrame:
    """``cluster, cluster_inertia, inertia, centroid, centroid_sha256``: a row for each centroid."""
    total = _long(sum(inertias.values()))
    rows = [
        (number, _long(inertias.get(number, 0)), total, own) for number, own in enumerate(centroids.numbers.tolist())
    ]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return table.withColumn("centroid_sha256", _digest(F.col("centroid").cast("array<string>")))


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid``, a row for each vector kept.

    ``vectors`` has ``vec_id`` and ``embedding``; vectors that are null, have other than 64 components, or a null or
    non-finite one take no part. A component becomes ``floor(256 * x)``, held within 2^26, where squared distances surely
    fit 64 bits. The start is the ``k`` vectors with the smallest ``sha256("<seed>:<vec_id>")``, all where there are
    fewer; a null ``vec_id`` comes last there and stays null. Repeated rows are vectors of their own. Equal distances go to the
    smaller number; of equal centroids the later ones stay empty and unmoved. An empty table gives an empty one.
    An inertia that does not fit 64 bits is null.
    """
    packed = stored(packed_vectors(vectors, seed), "centroids-planes")
    centroids = starting_centroids(packed, k)
    if not len(centroids.numbers):
        columns = ["cluster_inertia bigint", "inertia bigint", "centroid_sha256 string", "centroid array<bigint>"]
        return packed.sparkSession.createDataFrame([], ", ".join([ASSIGNED, *columns]))
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    final = functools.partial(_assigned, centroids=centroids)
    assigned = stored(packed.select("vec_id", "planes").mapInArrow(final, ASSIGNED), "centroids-assigned")
    # One row per centroid: the size of what is fetched and broadcast is set by k.
    inertias = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    facts = centroid_table(packed.sparkSession, centroids, {row["cluster"]: int(row["own"]) for row in inertias})
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
