"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same set of shingles are first taken together. What is left is sorted in several orders, a tree of the
forest each, by a part of its signature. In a sorted order documents of like signatures stand side by side: those that
share a prefix of at least ``LEAST_DEPTH`` values form a region, and the candidates are the next two neighbours of each
document there and the core of its region. The core is found by going down the fullest branch, as deep as the region is
dense. Cores differ from tree to tree, so that in a large group every document meets many others, though never all.
Candidates are then confirmed on their full sets, and confirmed links joined to components.

What the forest has missed is found by an exact step. Put in an order that all sets share, two linked sets have one of
their first shingles in common: no more can be left out at the start of a set than it may lack of the other. Shingles at
the start of sets of several components are looked up, and all pairs across components that meet there are confirmed on
their full sets, unless their sizes or the places of the shingle rule a link out. Where many would have to meet, the
documents with most links of their components meet all others first, so that stars fall together. Links inside a
component are not looked for, as they change nothing.

Any order will do, but rare shingles should come first, as a shingle at the start of many sets makes them all meet. The
order starts with a guess from a sample. Then the shingles at the starts are counted, all of them: those at which many
sets meet go to the end of the order, the more the later, and the sets that had them at their start get a new one. So
documents that share a passage, but little else, do not meet.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.llm.components import components
from playlog.llm.tables import (
    as_bytes,
    bits_set,
    blocks,
    bounded_sample,
    emptied,
    free_name,
    id_bit,
    id_bitmap,
    release,
    stored,
    stored_at,
    words_of,
)
from playlog.session import work_folder

TREES = 16
DEPTH = 8  # values of a signature in a tree
LEAST_DEPTH = 4
VALUE_BYTES = 2
PATH_BYTES = 1 + DEPTH * VALUE_BYTES  # the tree's number leads
REGION_BYTES = 1 + LEAST_DEPTH * VALUE_BYTES
BLOCK_ROWS = 8_192  # of a region looked at together
SLICE_ROWS = 512  # of pairs or sets that are taken apart together
MOVED_BITS = 24  # of the bitmaps that tell which shingles were moved, 2 MB each
CONTESTED_BITS = (24, 29)  # least and most of the bitmap that tells which shingles are contested, 2 and 64 MB
BITS_EACH = 16  # of that bitmap for each contested shingle, up to the most
# A shingle has a bit of a bitmap for each of these shifts. The first of its bits are left out: the shingles at the start of a
# set are the smallest of it, so that they differ little there.
SHIFTS = (0, 15, 30)
SAMPLE = 10_000  # documents that tell which shingles are common; the order of shingles decides about time only
COMMON = 200_000
MANY = 4  # pairs to look at, for each document, from which on hubs go first
MET = (32, 128, 512)  # sets at whose start a shingle is, from which on it goes further to the end of the order
MOVES = 2  # how often the order is mended
FOLDED = [f"parity_{place}" for place in range(4)]  # the parities of a set as 256 bits

SIGNED = "doc_id bigint, n_shingles bigint, key binary, signature binary, start binary, parity binary"
CANDIDATES = "a bigint, b bigint, region binary"

_random = np.random.default_rng(20)
_SALTS, _FACTORS = (_random.integers(0, 1 << 63, (TREES * DEPTH, 1), np.uint64).astype(np.uint32) for _ in range(2))
_FACTORS |= np.uint32(1)
_ROLL = [int(x) for x in _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)]

def _word_hashes(words: list[bytes]) -> np.ndarray:
    # Hashing a word takes no longer than looking it up, and most texts have words that were not there before.
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; with fewer words than ``size`` the whole text is one."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = _word_hashes(words)
    size = min(size, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for place in range(size):
        mixed = (mixed ^ hashes[place : len(words) - size + 1 + place]) * np.uint64(_ROLL[place])
        mixed ^= mixed >> np.uint64(31)
    mixed.sort()
    return mixed[np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))]


def signature(shingles: np.ndarray) -> bytes:
    """The least value of each hash function over a set, two bytes of it each.

    The functions work on the first 32 bits of a shingle, as products of 32 bits are several times quicker.
    """
    own = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(own), 1024):
        hashed = own[start : start + 1024] ^ _SALTS
        hashed *= _FACTORS
        np.minimum(least, hashed.min(axis=1), out=least)
    # The first bits of a least value are 0 more often than not in a large set; the ones after them are even.
    least ^= least >> np.uint32(13)
    return least.astype(">u2").tobytes()


def _told(bitmap: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The places of the shingles that have all their bits set."""
    found = np.arange(len(shingles))
    for shift in SHIFTS:
        bits = (shingles[found] >> np.uint64(shift)) & np.uint64(8 * len(bitmap) - 1)
        found = found[(bitmap[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return found


@dataclass(frozen=True)
class Order:
    """An order of all shingles: by how far they were moved to the end, by how many documents of a sample have them, by
    their value. Moved shingles are told by bitmaps of a fixed size; others that meet their bits are moved with them."""

    known: np.ndarray
    counts: np.ndarray
    moved: tuple[np.ndarray, ...] = ()

    def steps(self, shingles: np.ndarray) -> np.ndarray:
        """How far each shingle was moved."""
        steps = np.zeros(len(shingles), np.int64)
        for step, bitmap in enumerate(self.moved, 1):
            steps[_told(bitmap, shingles)] = step
        return steps

    def start_of(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """The first of the sorted shingles of a set in this order: sets that are linked share one of their firsts."""
        n = len(shingles) - -(-percent * len(shingles) // 100) + 1
        rank = self.steps(shingles) << 32
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            rank += np.where(self.known[place] == shingles, self.counts[place], 0)
        # Most shingles have been neither moved nor seen in the sample, and come first as they are.
        first = np.flatnonzero(rank == 0)[:n]
        if len(first) < n:
            rest = np.flatnonzero(rank)
            first = np.concatenate([first, rest[np.argsort(rank[rest], kind="stable")][: n - len(first)]])
        return shingles[first]


def key_of(shingles: np.ndarray) -> bytes:
    """What equal sets have in common and no others."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def parity_of(shingles: np.ndarray) -> bytes:
    """For each of some bits, a power of two that grows with the set, whether an odd number of shingles fall on it."""
    bits = max(64 * len(FOLDED), 64 << max(0, (len(shingles) // 16).bit_length() - 1))
    own = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(own.astype(np.uint8), bitorder="little").tobytes()


def at_most_common(one: bytes, other: bytes, n: int) -> int:
    """How many shingles two sets of ``n`` together can have in common: each odd bit is one that only one of them has."""
    while len(one) != len(other):
        # Bits that become one are as odd as their sum.
        long = max(one, other, key=len)
        half = len(long) // 2
        folded = (int.from_bytes(long[:half], "little") ^ int.from_bytes(long[half:], "little")).to_bytes(half, "little")
        one, other = (folded, other) if long is one else (one, folded)
    return (n - (int.from_bytes(one, "little") ^ int.from_bytes(other, "little")).bit_count()) // 2


def _tally(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        sets = [shingle_set(text, size) for text in as_bytes(block.column("text"))]
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        yield pa.record_batch({"shingle": pa.array(found.view(np.int64)), "n": pa.array(counts.astype(np.int64))})
    release()


def sampled_order(docs: DataFrame, size: int) -> Order:
    """An order by the counts of a bounded sample."""
    sample = bounded_sample(docs, "doc_id", SAMPLE).select("text")
    tallied = sample.mapInArrow(functools.partial(_tally, size=size), "shingle bigint, n bigint")
    tallied = tallied.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    found = tallied.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles, counts = (found.column(name).to_numpy() for name in ("shingle", "n"))
    shingles = shingles.astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return Order(shingles[order], counts.astype(np.int64)[order])


def _signed(
    batches: Iterator[pa.RecordBatch], size: int, percent: int, order: Order
) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        counts, keys, signatures, starts, parities = [], [], [], [], []
        for text in as_bytes(block.column("text")):
            shingles = shingle_set(text, size)
            counts.append(len(shingles))
            keys.append(key_of(shingles) if len(shingles) else None)
            signatures.append(signature(shingles) if len(shingles) else None)
            starts.append(order.start_of(shingles, percent).tobytes() if len(shingles) else None)
            parities.append(parity_of(shingles) if len(shingles) else None)
        yield pa.record_batch(
            {
                "doc_id": block.column("doc_id"),
                "n_shingles": pa.array(counts, pa.int64()),
                "key": pa.array(keys, pa.binary()),
                "signature": pa.array(signatures, pa.binary()),
                "start": pa.array(starts, pa.binary()),
                "parity": pa.array(parities, pa.binary()),
            }
        )
    release()


def _core(paths: np.ndarray) -> int:
    """The row of a region's core: down the fullest branch until it does not divide any more."""
    first, last = 0, len(paths)
    for depth in range(LEAST_DEPTH, DEPTH):
        at = 1 + depth * VALUE_BYTES
        values = paths[first:last, at].astype(np.int64) * 256 + paths[first:last, at + 1]
        edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
        sizes = np.diff(edges)
        best = int(sizes.argmax())
        if sizes[best] == 1:
            break
        first, last = first + edges[best], first + edges[best + 1]
    return first


def _neighbours(paths: np.ndarray, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, list[int]]:
    """Candidates among sorted rows, as lists of ids; the edges of the regions; and the row of each region's core."""
    same = (paths[1:, :REGION_BYTES] == paths[:-1, :REGION_BYTES]).all(axis=1)
    edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    left, right = [ids[:-1][same]], [ids[1:][same]]
    next_but_one = same[1:] & same[:-1]
    left.append(ids[:-2][next_but_one])
    right.append(ids[2:][next_but_one])
    cores = edges[:-1].tolist()
    for region in np.flatnonzero(np.diff(edges) > 3):
        first, last = edges[region], edges[region + 1]
        cores[region] = core = first + _core(paths[first:last])
        left.append(np.full(last - first, ids[core]))
        right.append(ids[first:last])
    return left, right, edges, cores


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one range of a sorted order, and the cores of the regions at its ends, which may go on beyond."""
    held_paths, held_ids = np.empty((0, PATH_BYTES), np.uint8), np.empty(0, np.int64)
    at_start = True

    def found(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(left), np.concatenate(right)
        real = a != b
        a, b = np.minimum(a, b)[real], np.maximum(a, b)[real]
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b), "region": pa.nulls(len(a), pa.binary())})

    def border(core: int) -> pa.RecordBatch:
        ids = pa.array([held_ids[core]], pa.int64())
        region = held_paths[core, :REGION_BYTES].tobytes()
        return pa.record_batch({"a": ids, "b": ids, "region": pa.array([region], pa.binary())})

    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).reshape(-1, PATH_BYTES)
        held_paths = np.concatenate([held_paths, own])
        held_ids = np.concatenate([held_ids, batch.column("doc_id").to_numpy()])
        # The last region may go on in the next batch.
        differs = (held_paths[1:, :REGION_BYTES] != held_paths[:-1, :REGION_BYTES]).any(axis=1)
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            left, right, _, cores = _neighbours(held_paths[:cut], held_ids[:cut])
            if at_start:
                yield border(cores[0])
                at_start = False
            yield found(left, right)
            held_paths, held_ids = held_paths[cut:], held_ids[cut:]
        if len(held_ids) > BLOCK_ROWS:
            # What follows meets the last row and the core of what has been seen of the region.
            left, right, _, cores = _neighbours(held_paths, held_ids)
            yield found(left, right)
            kept = [cores[0], len(held_ids) - 1]
            held_paths, held_ids = held_paths[kept], held_ids[kept]
    if len(held_ids):
        left, right, _, cores = _neighbours(held_paths, held_ids)
        yield border(cores[0])
        yield found(left, right)


def candidates(signed: DataFrame) -> DataFrame:
    """``a, b``: distinct candidate pairs of ``doc_id, signature``, a below b."""
    step = DEPTH * VALUE_BYTES
    paths = [
        F.concat(F.lit(bytes([tree])), F.substring("signature", tree * step + 1, step)) for tree in range(TREES)
    ]
    trees = signed.select("doc_id", F.explode(F.array(*paths)).alias("path"))
    trees = trees.repartitionByRange("path", "doc_id").sortWithinPartitions("path", "doc_id")
    found = stored(trees.mapInArrow(_candidates, CANDIDATES), "dedup-candidates")
    pairs = found.where(F.col("region").isNull()).select("a", "b")
    # A region that goes on over the end of a range: its cores on both sides are candidates.
    borders = found.where(F.col("region").isNotNull()).select("a", "region")
    hubs = borders.groupBy("region").agg(F.min("a").alias("hub"))
    over = borders.join(hubs, "region").where("a <> hub").select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b"))
    return pairs.unionByName(over).distinct()


def _with_bit(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows whose bit is set."""
    for block in blocks(batches, "text"):
        yield block.filter(pa.array(bits_set(block.column("bit"), bitmap)))


def _sets(batches: Iterator[pa.RecordBatch], size: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block in _with_bit(batches, bitmap):
        sets = [shingle_set(text, size).tobytes() for text in as_bytes(block.column("text"))]
        yield pa.record_batch({"id": block.column("doc_id"), "shingles": pa.array(sets, pa.binary())})
    release()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        good = []
        for one, other in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                good.append(False)
                continue
            place = np.minimum(np.searchsorted(x, y), len(x) - 1)
            common = int((x[place] == y).sum())
            good.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: the pairs whose sets of shingles have at least ``percent`` of their union in common."""
    # Texts are not shuffled to find those of the pairs: they are told by a bitmap of ids where they are read.
    bitmap = id_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    found = docs.select("doc_id", "text", id_bit(F.col("doc_id")).alias("bit")).mapInArrow(
        functools.partial(_sets, size=size, bitmap=bitmap), "id bigint, shingles binary"
    )
    path = work_folder(docs.sparkSession, "dedup-sets")
    sets = stored_at(found, path)
    joined = pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "set_b"}), "b")
    joined = joined.join(sets.withColumnsRenamed({"id": "a", "shingles": "set_a"}), "a")
    joined = joined.select("a", "b", "set_a", "set_b")
    good = stored(joined.mapInArrow(functools.partial(_confirmed, percent=percent), "a bigint, b bigint"), "dedup-confirmed")
    emptied(docs.sparkSession, path)
    return good


def _moving(batches: Iterator[pa.RecordBatch], old: Order, new: Order) -> Iterator[pa.RecordBatch]:
    """The ids of sets that have a shingle at their start which the new order moves."""
    for batch in _slices(batches):
        starts = batch.column("start").to_pylist()
        shingles = np.frombuffer(b"".join(starts), np.uint64)
        moves = new.steps(shingles) > old.steps(shingles)
        ends = np.cumsum([len(start) // 8 for start in starts])
        before = np.concatenate([[0], np.cumsum(moves)])
        yield batch.select(["id"]).filter(pa.array(np.diff(before[ends], prepend=0) > 0))


def _restarted(
    batches: Iterator[pa.RecordBatch], size: int, percent: int, order: Order, bitmap: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for block in _with_bit(batches, bitmap):
        sets = [own for text in as_bytes(block.column("text")) if len(own := shingle_set(text, size))]
        keys, starts = [key_of(own) for own in sets], [order.start_of(own, percent).tobytes() for own in sets]
        yield pa.record_batch({"key": pa.array(keys, pa.binary()), "start": pa.array(starts, pa.binary())})
    release()


def _bitmap(shingles: DataFrame, bits: int = MOVED_BITS) -> np.ndarray:
    """A bitmap of ``2 ** bits`` with the bits of all shingles set; filled in the tasks."""
    places = [F.shiftrightunsigned("shingle", shift).bitwiseAND(F.lit((1 << bits) - 1)) + 1 for shift in SHIFTS]
    places = shingles.select(F.explode(F.array(*places)).alias("place"))
    places = places.select(F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    # Bits are shuffled rather than bitmaps, of which every task would have one for each bucket.
    bitmaps = places.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in bitmaps.collect():
        own = np.frombuffer(row["bits"], np.uint8)
        out[(row["bucket"] - 1) * len(own) : row["bucket"] * len(own)] = own
    return out


def contested_bits(contested: int) -> int:
    """The bits of a bitmap of so many shingles, as a power of two: enough that hardly any others are told with them."""
    least, most = CONTESTED_BITS
    return min(max(least, (BITS_EACH * contested - 1).bit_length()), most)


def mended(docs: DataFrame, vertices: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """``vertices`` with the starts of their sets by an order that has shingles at which many would meet at its end.

    A set without a shingle at its start that is moved keeps its start, as what stays keeps its order.
    """
    spark, path = docs.sparkSession, work_folder(docs.sparkSession, "dedup-starts")
    vertices = stored_at(vertices, path)
    for _ in range(MOVES):
        firsts = vertices.select("id", "n", "component", "start").mapInArrow(_firsts, FIRSTS)
        counted = firsts.groupBy("shingle").agg(
            F.count("*").alias("met"), F.min("component").alias("least"), F.max("component").alias("most")
        )
        met = stored(counted.where((F.col("least") < F.col("most")) & (F.col("met") >= MET[0])).select("shingle", "met"), "dedup-met")
        if met.isEmpty():
            break
        bitmaps = [_bitmap(met.where(F.col("met") >= least)) for least in MET]
        moved = order.moved or tuple(np.zeros_like(bitmap) for bitmap in bitmaps)
        new = Order(order.known, order.counts, tuple(a | b for a, b in zip(moved, bitmaps, strict=True)))
        moving = vertices.select("id", "start").mapInArrow(functools.partial(_moving, old=order, new=new), "id bigint")
        moving = stored(moving, "dedup-moving")
        if moving.isEmpty():
            break
        again = functools.partial(_restarted, size=size, percent=percent, order=new, bitmap=id_bitmap(moving))
        told = docs.select("doc_id", "text", id_bit(F.col("doc_id")).alias("bit"))
        starts = told.mapInArrow(again, "key binary, start binary").groupBy("key").agg(F.first("start").alias("moved"))
        joined = vertices.join(starts, "key", "left").withColumn("start", F.coalesce("moved", "start"))
        before, path = path, work_folder(spark, "dedup-starts")
        vertices, order = stored_at(joined.select(*vertices.columns), path), new
        emptied(spark, before)
    return vertices


def _firsts(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each shingle at the start of a set, with its place there.

    With a bitmap, only of those whose bits are set, and with the parities of the set, folded to 256 bits.
    """
    for batch in _slices(batches):
        starts = batch.column("start").to_pylist()
        sizes = np.array([len(start) // 8 for start in starts], np.int64)
        ends = np.cumsum(sizes)
        shingles = np.frombuffer(b"".join(starts), np.uint64)
        folded: dict[str, np.ndarray] = {}
        row = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(row)) - np.repeat(ends - sizes, sizes)
        if bitmap is not None:
            told = _told(bitmap, shingles)
            shingles, row, place = shingles[told], row[told], place[told]
            parities = batch.column("parity").to_pylist()
            own = [np.bitwise_xor.reduce(np.frombuffer(parity, "<i8").reshape(-1, len(FOLDED))) for parity in parities]
            folded = dict(zip(FOLDED, np.array(own, np.int64).reshape(-1, len(FOLDED))[row].T, strict=True))
        columns = {"shingle": pa.array(shingles.view(np.int64)), "place": pa.array(place.astype(np.int32))}
        columns |= {name: pa.array(own) for name, own in folded.items()}
        yield pa.record_batch({name: batch.column(name).take(pa.array(row)) for name in ("id", "n", "component")} | columns)


FIRSTS = "id bigint, n bigint, component bigint, shingle bigint, place int"
MEETING = ", ".join([FIRSTS, *[f"{name} bigint" for name in FOLDED]])


def _meeting(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs across components that share a first shingle and may be linked by their sizes, its places and the
    parities of their sets."""
    left = left.select("shingle", *[F.col(name).alias(f"{name}_l") for name in left.columns if name != "shingle"])
    right = right.select("shingle", *[F.col(name).alias(f"{name}_r") for name in right.columns if name != "shingle"])
    # At the first shingle that two sets share, no more than the rest of either can follow in common.
    most = 1 + F.least(F.col("n_l") - F.col("place_l") - 1, F.col("n_r") - F.col("place_r") - 1)
    # Each odd bit is a shingle that only one of them has: texts that share little else make no pair.
    odd = functools.reduce(operator.add, [F.bit_count(F.col(f"{name}_l").bitwiseXOR(F.col(f"{name}_r"))) for name in FOLDED])
    most = F.least(most, F.shiftright(F.col("n_l") + F.col("n_r") - odd, 1))
    fits = 100 * most >= percent * (F.col("n_l") + F.col("n_r") - most)
    pairs = left.join(right, (left["shingle"] == right["shingle"]) & (left["component_l"] != right["component_r"]) & fits)
    return pairs.select(F.least("id_l", "id_r").alias("a"), F.greatest("id_l", "id_r").alias("b")).distinct()


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        good = []
        for one, other, n in zip(*(batch.column(name).to_pylist() for name in ("parity_a", "parity_b", "n")), strict=True):
            most = at_most_common(one, other, n)
            good.append(100 * most >= percent * (n - most))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def possible(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs that the parities of their sets do not rule out: far fewer, so that few full sets are shuffled."""
    own = vertices.select("id", "n", "parity")
    joined = pairs.join(own.toDF("a", "n_a", "parity_a"), "a").join(own.toDF("b", "n_b", "parity_b"), "b")
    joined = joined.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "parity_a", "parity_b")
    return joined.mapInArrow(functools.partial(_possible, percent=percent), "a bigint, b bigint").distinct()


def _merged(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """The vertices with their components joined over further links."""
    own = vertices.select("id", "component")
    ends = links.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(ends).toDF("component", "to")
    merged = vertices.join(joined, "component", "left").withColumn("component", F.coalesce("to", "component"))
    return stored(merged.select(*vertices.columns), "dedup-vertices")


def completed(docs: DataFrame, vertices: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """``id, component``: components joined over all links that are not in ``links`` yet.

    ``vertices`` has ``id, n, start, parity, component`` of every distinct set, components being those of ``links``.
    """
    sets = vertices
    firsts = sets.select("id", "n", "component", "start").mapInArrow(_firsts, FIRSTS)
    contested = firsts.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    contested = stored(contested.where("least < most").select("shingle"), "dedup-contested")
    # Few shingles are contested: the others are left where they are, told by a bitmap. It grows with the contested ones, as
    # in one of a fixed size the others that are told would grow with the square of the input.
    bitmap = _bitmap(contested, contested_bits(contested.count()))
    told = sets.select("id", "n", "component", "start", "parity").mapInArrow(functools.partial(_firsts, bitmap=bitmap), MEETING)
    meet = stored(told.join(contested, "shingle").select("id", "n", "shingle", "place", *FOLDED), "dedup-meet")
    # Texts of one id that differ are several sets, but one vertex.
    vertices = stored(vertices.select("id", "component").distinct(), "dedup-vertices")
    total = vertices.count()
    with_hubs = True
    while True:
        rows = stored(meet.join(vertices, "id"), "dedup-rows")
        # In each place the members of the largest component need not meet one another.
        counted = rows.groupBy("shingle", "component").agg(F.count("*").alias("own"))
        main = counted.groupBy("shingle").agg(F.max(F.struct("own", "component")).alias("main"), F.sum("own").alias("all"))
        main = stored(main.where("main.own < all").select("shingle", "main.own", F.col("main.component").alias("main"), "all"), "dedup-main")
        work = main.agg(F.sum(F.col("all").cast("double") * (F.col("all") - F.col("own")))).first()[0] or 0.0
        if not work:
            return vertices
        rows = rows.join(main.select("shingle", "main"), "shingle")
        members = rows.select("shingle", "id", "n", "place", "component", *FOLDED)
        last = not with_hubs or work <= MANY * total
        if last:
            strays = rows.where("component <> main").drop("main")
            pairs = _meeting(strays, members, percent)
        else:
            degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().join(vertices, "id")
            hubs = degrees.groupBy("component").agg(F.max_by("id", F.struct("count", -F.col("id"))).alias("id")).select("id")
            pairs = _meeting(members.join(hubs, "id"), members, percent)
        pairs = stored(possible(stored(pairs, "dedup-pairs"), sets, percent), "dedup-possible")
        if not pairs.isEmpty():
            found = stored(confirmed(docs, pairs, size, percent), "dedup-links")
            vertices = _merged(vertices, found)
        if last:
            return vertices
        with_hubs = False


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each input row.

    ``docs`` has ``doc_id`` and ``text``. A document's set holds its distinct shingles of ``size`` lower-cased words; with
    fewer words the whole text is one shingle. Two documents are linked if ``100 * common >= percent * all`` of their
    shingles. ``component_id`` is the smallest id reachable over links, ``kept`` is true for that document. A text that is
    null or has no words has no shingles and is linked with nothing. Rows with the same id stand for one document; a null
    id is linked with nothing and kept. An empty table gives an empty one.

    Shingles are compared by 64-bit hashes.
    """
    order = sampled_order(docs, size)
    sign = functools.partial(_signed, size=size, percent=percent, order=order)
    signed = docs.select("doc_id", "text").mapInArrow(sign, SIGNED)
    # What is large is written twice at most at a time: a table goes as soon as the next one holds what is needed of it.
    spark = docs.sparkSession
    signed_path, same_path = work_folder(spark, "dedup-signed"), work_folder(spark, "dedup-same")
    signed = stored_at(signed, signed_path)
    usable = signed.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    # Equal sets are one vertex, named by the smallest id.
    same = usable.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), *[F.first(name).alias(name) for name in ("signature", "n_shingles", "start", "parity")]
    )
    same = stored_at(same, same_path)
    placed = signed.drop("signature", "start", "parity").join(same.select("key", "first_id"), "key", "left")
    placed = stored(placed, "dedup-placed")
    emptied(spark, signed_path)
    pairs = candidates(same.select(F.col("first_id").alias("doc_id"), "signature"))
    pairs = stored(pairs, "dedup-pairs")
    named = docs.where(F.col("doc_id").isNotNull())
    links = confirmed(named, pairs, size, percent)
    # Rows of one id whose texts differ are one document, so what they stand for is linked.
    several = placed.groupBy("doc_id").agg(F.min("first_id").alias("a"), F.max("first_id").alias("b"))
    several = several.where("a < b").select("doc_id", "a")
    links = links.unionByName(placed.join(several, "doc_id").select("a", F.col("first_id").alias("b")))
    links = stored(links, "dedup-links")
    vertices = same.select(F.col("first_id").alias("id"), F.col("n_shingles").alias("n"), "key", "start", "parity")
    vertices = vertices.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    vertices = mended(named, vertices, order, size, percent)
    emptied(spark, same_path)
    found = completed(named, vertices, links, size, percent)
    component = F.coalesce("component", "first_id", "doc_id")
    return (
        placed.join(found.withColumnRenamed("id", "first_id"), "first_id", "left")
        .withColumn("component_id", component)
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _picked(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose bit, in their last column, is set, or not; without that column."""
    for batch in batches:
        columns = batch.schema.names[:-1]
        yield batch.select(columns).filter(pa.array(bits_set(batch.column(len(columns)), bitmap) == wanted))
    release()


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all their columns, without those that are near-duplicates of one with a smaller id.

    Of rows with the same id one stays; rows with a null id all stay, as do null and empty texts of different ids. Columns of
    any name are kept as they are, an empty table gives an empty one. Only texts that may have to go are shuffled.
    """
    columns = [F.col(f"`{name}`") for name in docs.columns]
    decided = stored(near_duplicates(docs, size, percent).select("doc_id", "kept"), "dedup-decided")
    going = decided.where("NOT kept").select("doc_id").distinct()
    several = decided.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    bitmap = id_bitmap(going.union(several).toDF("id"))
    told = docs.withColumn(free_name(docs, "bit"), id_bit(F.col("doc_id")))
    staying, doubtful = (
        told.mapInArrow(functools.partial(_picked, bitmap=bitmap, wanted=wanted), docs.schema)
        for wanted in (False, True)
    )
    checked = doubtful.join(going, "doc_id", "left_anti").select(*columns).dropDuplicates(["doc_id"])
    return staying.unionByName(checked)
