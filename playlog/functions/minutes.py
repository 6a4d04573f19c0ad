"""Sums of minutes played."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark sums decimals of up to 8 digits in a long; wider ones go through big decimals, at about twice the time.
_LONG_DIGITS = 8


def sum_minutes(plays: DataFrame, keys: dict[str, Column], zero: bool, count: str | None = None) -> DataFrame:
    """Minutes per key: one map-side combined aggregation, exact whatever the order of the rows.

    Values that fit into a long-backed decimal are summed there, the others beside them in full width. A group without
    any minutes gives null, or 0 with ``zero``. The sum stays a decimal; ``shown`` makes it a double at the end.
    ``count`` names a column for the number of rows.
    """
    grouped = plays.groupBy(*[column.alias(name) for name, column in keys.items()])
    counts = [F.count("*").alias(count)] if count else []
    sums, total = minute_sums(plays.schema["minsplayed"].dataType)
    total = F.coalesce(total, F.lit(0)) if zero else total
    return grouped.agg(*sums, *counts).select(*keys, total.alias("minsplayed"), *([count] if count else []))


def minute_sums(kind: T.DataType) -> tuple[list[Column], Column]:
    """The aggregates that sum minutes of a type, and the sum from them, null for a group without any minutes."""
    if isinstance(kind, T.DecimalType) and kind.precision > _LONG_DIGITS and kind.scale < _LONG_DIGITS:
        short = f"decimal({_LONG_DIGITS},{kind.scale})"
        sums = [
            F.sum(F.col("minsplayed").try_cast(short)).alias("_short"),
            F.expr(f"sum(minsplayed) FILTER (WHERE try_cast(minsplayed AS {short}) IS NULL)").alias("_long"),
        ]
        return sums, F.coalesce(F.col("_short") + F.col("_long"), F.col("_short"), F.col("_long"))
    return [F.sum("minsplayed").alias("_sum")], F.col("_sum")


def shown(table: DataFrame) -> DataFrame:
    """A result table with its minutes as double."""
    return table.withColumn("minsplayed", F.col("minsplayed").cast("double"))
