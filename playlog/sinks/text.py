"""Semicolon-separated exports and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playlog.schema import READ_LOG, REQUEST_LOG

# The text format of exports. Moments are written in UTC, with as much of a fraction as they have.
CSV_FORMAT = {
    "sep": ";",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "dateFormat": "yyyy-MM-dd",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'",
}
NULL_TEXT = "NA"


def _written(field: T.StructField, null_text: str) -> Column:
    """A column as it is written. A text that would read back as null fails."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        seconds = F.unix_micros(column).cast("decimal(20,0)") / F.lit(1_000_000)
        zero, none = F.lit("1970-01-01").cast("timestamp_ntz"), F.lit(0)
        column = zero + F.make_dt_interval(none, none, none, seconds.cast("decimal(18,6)"))
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.translate(column.cast("string"), " ", "T"), F.lit("Z"))
    if isinstance(field.dataType, T.StringType):
        clash = F.raise_error(F.lit(f"{field.name} holds the text {null_text!r}, which stands for null: choose another"))
        return F.when(column == null_text, clash.cast("string")).otherwise(column)
    return column


def export_csv(
    table: DataFrame,
    path: str,
    files: int | None = None,
    mode: str = "errorifexists",
    order: Sequence[str | Column] = (),
    null_text: str = NULL_TEXT,
) -> str:
    """Write a table as CSV parts with a header each, from the executors; ``files`` sets their number.

    With ``order`` the parts follow each other in that order. Null is written as ``null_text``; a table that holds that
    very text cannot be written with it.
    """
    if order and files is not None:
        table = table.repartitionByRange(files, *order).sortWithinPartitions(*order)
    elif order:
        table = table.orderBy(*order)
    elif files is not None:
        table = table.repartition(files)
    table = table.select([_written(field, null_text).alias(field.name) for field in table.schema])
    table.write.mode(mode).options(**CSV_FORMAT, nullValue=null_text).csv(path)
    return path


def read_csv(
    spark: SparkSession, path: str, schema: str, multi_line: bool = False, null_text: str = NULL_TEXT
) -> DataFrame:
    """Read an export back; ``multi_line`` where a text may hold a line break, at the price of one task per file."""
    options = CSV_FORMAT | {"nullValue": null_text, "multiLine": str(multi_line).lower()}
    return spark.read.schema(schema).options(**options).csv(path)


def _append_log(rows: DataFrame, path: str, columns: list[str]) -> str:
    rows = rows.withColumn("timestamp", F.substring(F.col("timestamp").cast("string"), 1, 19))
    rows = rows.select(*[F.col(name).cast("string") for name in columns])
    # Rebalanced, as an append of a few rows should add one file.
    rows.hint("rebalance").write.mode("append").options(**CSV_FORMAT, nullValue=NULL_TEXT).csv(path)
    return path


def append_requests(requests: DataFrame, path: str) -> str:
    """Add requests, with ``timestamp, user, email, customerID, from, to``, to the request log."""
    return _append_log(requests, path, REQUEST_LOG)


def append_reads(reads: DataFrame, path: str) -> str:
    """Add accepted reads, with ``timestamp, user, dataset, import_from, import_to``, to the read log."""
    renamed = {"dataset": "datasetID", "import_from": "from", "import_to": "to"}
    return _append_log(reads.withColumnsRenamed(renamed), path, READ_LOG)


def read_log(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A log as text columns."""
    return read_csv(spark, path, ", ".join(f"`{name}` string" for name in columns))
