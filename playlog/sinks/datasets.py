"""Parquet datasets.

Before a write, rows are rebalanced on the folders they go to: adaptive execution then joins small partitions, so that
a small folder gets one file, and splits a large one over many tasks and files. Target size is
``spark.sql.adaptive.advisoryPartitionSizeInBytes``; ``max_records`` bounds the rows of a file on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from playlog.functions.keys import play_day, with_text_keys
from playlog.schema import PARTITION_COLUMNS
from playlog.sources.catalog import dataset_path


def stored(plays: DataFrame) -> DataFrame:
    """The form a dataset is kept in: text keys in place of the timestamp, at least the day's."""
    plays = with_text_keys(plays)
    if "ymd" not in plays.columns:
        plays = plays.withColumn("ymd", play_day(plays).cast("string"))
    return plays.drop("ts")


def _writer(plays: DataFrame, mode: str, max_records: int) -> DataFrameWriter:
    return plays.write.mode(mode).option("maxRecordsPerFile", max_records).option("compression", "snappy")


def write_dataset(
    plays: DataFrame,
    root: str,
    dataset: str,
    mode: str = "errorifexists",
    max_records: int = 0,
    rebalance: bool = True,
    seen: Observation | None = None,
) -> str:
    """Write a dataset with one folder per day and return its path. A dataset that exists is an error.

    ``seen`` gets the number of rows as ``n_rows``, counted while they are written.

    ``rebalance=False`` writes rows where they were read, without a shuffle: for an extract that keeps a large part of
    a source laid out by day. A small extract would get a small file from each task of the scan.
    """
    path = dataset_path(root, dataset)
    rows = stored(plays)
    rows = rows.hint("rebalance", "ymd") if rebalance else rows
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows")) if seen else rows
    _writer(rows, mode, max_records).partitionBy("ymd").parquet(path)
    return path


def append_dataset(
    plays: DataFrame, root: str, dataset: str, max_records: int = 0, rebalance: bool = True
) -> str:
    """Add plays to a dataset, or start it."""
    return write_dataset(plays, root, dataset, "append", max_records, rebalance)


def write_batch(
    extracts: DataFrame, root: str, mode: str = "errorifexists", max_records: int = 0, tasks: int | None = None
) -> str:
    """Write all datasets of a batch, each in its folder, and return the root.

    Rows are rebalanced by size: many small datasets come into few tasks, and a large one is split. Where creating files
    takes longer than writing rows, ``tasks`` deals the datasets out to so many tasks instead; a dataset is then written
    by one of them.

    Days are not folders here, as many small datasets would make many tiny files; rows are sorted by minute inside a
    file, so that the statistics in it let a range of days skip what it does not need.
    """
    rows = stored(extracts)
    order = "ymdhm" if "ymdhm" in rows.columns else "ymd"
    rows = rows.repartition(tasks, "dataset") if tasks else rows.hint("rebalance", "dataset")
    rows = rows.sortWithinPartitions("dataset", order)
    _writer(rows, mode, max_records).partitionBy("dataset").parquet(root)
    return root


def write_source(
    plays: DataFrame, path: str, customers: int = 1_000_000, row_group_bytes: int = 16 << 20, mode: str = "errorifexists"
) -> str:
    """Write plays as a source table, a folder per day, laid out so that one customer is found without reading a day.

    Inside a day, rows are dealt out by ranges of customers and sorted by them, so that the smallest and largest customer of
    a file or row group rule most of them out; a Bloom filter of the customers, sized for ``customers`` different ones, rules
    out those that hold the range but not the customer.
    """
    rows = stored(plays)
    day = F.col("ymd").try_cast("date")
    parts = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}
    order = [*PARTITION_COLUMNS, "customerID", *(["ymdhm"] if "ymdhm" in rows.columns else [])]
    rows = rows.withColumns(parts).repartitionByRange(*order).sortWithinPartitions(*order)
    writer = _writer(rows, mode, 0).option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.bloom.filter.enabled#customerID", True)
    writer = writer.option("parquet.bloom.filter.expected.ndv#customerID", customers)
    writer.partitionBy(*PARTITION_COLUMNS).parquet(path)
    return path


def compact_dataset(
    spark: SparkSession, source: str, target: str, files: int | None = None, max_records: int = 0
) -> str:
    """Rewrite a dataset with few files and return its path.

    By default the number of files follows the size; ``files`` asks for a number, 1 included. Files hold consecutive
    ranges of minutes, so that a range of days is read from few of them.
    """
    plays = spark.read.parquet(source)
    if "ymd" in plays.columns:
        # Folder names are read as dates.
        plays = plays.withColumn("ymd", F.col("ymd").cast("string"))
    order = next((name for name in ("ymdhm", "ymd") if name in plays.columns), None)
    if order is None:
        plays = plays.hint("rebalance") if files is None else plays.repartition(files)
    else:
        dealt = plays.repartitionByRange(order) if files is None else plays.repartitionByRange(files, order)
        plays = dealt.sortWithinPartitions(order)
    _writer(plays, "errorifexists", max_records).parquet(target)
    return target
