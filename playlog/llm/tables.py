"""The tables the operators read, and what several of them share: words, learning folds, batches, sampling, scratch tables.

Every operator takes the columns it names, in any order, and returns exactly the columns its docstring lists: further
columns of its input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.session import work_folder

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"
PAGES = "page_id bigint, url string, html string"
LABELS = "doc_id bigint, quality int, toxic int"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Bytes of text that are worked on at once inside a task.
BLOCK_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    """A table with its schema given, so that no file is opened to plan a query."""
    return spark.read.schema(schema).parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", DOCUMENTS)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of an id as text, modulo a divisor: what divides documents into learning and held-out ones.

    A null id counts as an empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of a UTF-8 text; bytes split at exactly the six ASCII white spaces."""
    return text.lower().split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b"" if text is None else text for text in column.cast(pa.large_binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Texts, null as empty."""
    return ["" if text is None else text for text in column.to_pylist()]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in blocks of about ``most`` bytes of a text column, so that memory stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not this C library
        return lambda _: 0


def trim() -> None:
    """Give memory that a worker has freed back to the system, for what runs beside it and after it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


_kept: list[dict] = []


def kept() -> dict:
    """A table of what a worker keeps for its next task, until a task of an operator that needs none of it is over."""
    _kept.append({})
    return _kept[-1]


def release() -> None:
    """``trim``, and drop what other operators have kept in this worker."""
    for table in _kept:
        table.clear()
    trim()


def drawn(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with a column ``name`` from 0 to below 1, drawn for each row: from its key, and its place, as keys may repeat or
    be missing. It is the same on every run over the same files."""
    steps = 1 << 30
    number = F.pmod(F.xxhash64(F.lit("sample"), F.col(key), F.monotonically_increasing_id()), F.lit(steps))
    return rows.withColumn(name, number / steps)


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame has not, whatever the case."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, drawn by their key and place: all where they are few."""
    n = rows.count()
    if n <= most:
        return rows
    name = free_name(rows, "drawn")
    return drawn(rows, key, name).where(F.col(name) < most / n).drop(name)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared work folder and read back: its lineage is cut and no executor is needed for it."""
    return stored_at(frame, work_folder(frame.sparkSession, name))


def stored_at(frame: DataFrame, path: str) -> DataFrame:
    """``stored`` at a path of ``work_folder``, which ``emptied`` takes."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Give back the disk of a table that nothing reads any more, neither now nor by a frame that is not evaluated yet."""
    spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def count_words(column: pa.Array) -> np.ndarray:
    """The number of words of each text, null as none: starts of words, counted over the joined bytes of the column."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(len(column), np.int64)
    inside = _WORD_BYTE[np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = (ends[:-1] - ends[0])[ends[1:] > ends[:-1]]
    starts[first] = inside[first]
    before = np.concatenate([[0], np.cumsum(starts)])
    return np.diff(before[ends - ends[0]])


# A set of ids is told apart in advance by so many bits: 2 MB, however large the set. Ids that meet a bit by chance are
# sorted out by a join later, so the number of bits decides about time only.
ID_BITS = 1 << 24
_BITMAP_BITS = 32_768  # of one of Spark's bitmaps


def id_bit(doc_id: Column) -> Column:
    """The bit of an id; null for a null id."""
    return F.when(doc_id.isNotNull(), F.pmod(F.xxhash64(F.lit("bit"), doc_id), F.lit(ID_BITS)))


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """The bits of all ids of a column ``id``, as bytes. The bitmaps are filled in the tasks."""
    place = id_bit(F.col("id")) + 1
    bitmaps = (
        ids.where(F.col("id").isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )
    out = np.zeros(ID_BITS // 8, np.uint8)
    size = _BITMAP_BITS // 8
    for row in bitmaps.collect():
        start = (row["bucket"] - 1) * size
        out[start : start + size] = np.frombuffer(row["bits"], np.uint8)
    return out


def bits_set(column: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Which bits of a column are set; a null one is not."""
    bits = pa.compute.fill_null(column, -1).to_numpy(zero_copy_only=False)
    return (bits >= 0) & ((bitmap[np.maximum(bits, 0) >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool)
