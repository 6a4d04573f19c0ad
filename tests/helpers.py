from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from playlog.functions.keys import with_text_keys


def timestamped(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of customer, genre, minutes, time text."""
    data = [
        (customer, genre, None if minutes is None else Decimal(minutes), when and dt.datetime.fromisoformat(when))
        for customer, genre, minutes, when in rows
    ]
    return spark.createDataFrame(
        data, "customerID string, genre string, minsplayed decimal(18,2), ts timestamp_ntz"
    )


def text_keyed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return with_text_keys(timestamped(spark, rows)).drop("ts")


SHAPES = [timestamped, text_keyed]


def values(frame: DataFrame) -> list[tuple]:
    """Rows in the order of the plan."""
    return [tuple(row) for row in frame.collect()]


def plan(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
