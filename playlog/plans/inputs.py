"""Requests and form inputs derived from the given tables, one per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.operators.extract import dataset_id
from playlog.sources.plays import read_events, read_lineitem


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user: from the user's first day on, for up to 20 days."""
    users = read_events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("timestamp"))
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    first = F.to_date("timestamp")
    return users.select(
        dataset_id(user, F.col("timestamp")).alias("dataset"),
        F.col("timestamp"),
        user.alias("user"),
        F.concat(user, F.lit("@example.com")).alias("email"),
        F.col("user_id").cast("string").alias("customerID"),
        first.alias("from"),
        F.date_add(first, (F.col("user_id") % 20).cast("int")).alias("to"),
    )


def late_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, every seventh user's moved to a time without plays."""
    late = F.col("customerID").cast("bigint") % 7 == 0
    return requests(spark, sf_dir).withColumns(
        {name: F.when(late, F.date_add(name, 400)).otherwise(F.col(name)) for name in ("from", "to")}
    )


def long_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier of ``lineitem``: from its first day on, for up to seven years."""
    suppliers = read_lineitem(spark, sf_dir).groupBy("l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("from"))
    return suppliers.select(
        F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("dataset"),
        F.col("l_suppkey").cast("string").alias("customerID"),
        "from",
        F.date_add("from", (F.col("l_suppkey") * 37 % 2_500).cast("int")).alias("to"),
    )


def typed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late requests as typed texts, with mistakes spread over the users."""
    user = F.col("customerID").cast("bigint")
    return late_requests(spark, sf_dir).select(
        F.when(user % 17 == 0, "").when(user % 19 == 0, "same").otherwise(F.col("dataset")).alias("dataset"),
        "customerID",
        F.when(user % 13 == 0, "2024-02-30").otherwise(F.date_format("from", "yyyyMMdd")).alias("from"),
        F.when(user % 11 == 0, F.date_add("from", -1)).otherwise(F.col("to")).cast("string").alias("to"),
    )


def form_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user typed, with mistakes spread over the users."""
    user = F.col("customerID").cast("bigint")
    day = F.col("from")

    def pick(by: int, *texts: str | None):
        return F.element_at(F.array(*[F.lit(text) for text in texts]), (user % by + 1).cast("int"))

    return requests(spark, sf_dir).select(
        F.when(user % 3 == 0, F.concat("dataset", F.lit("x")))
        .when(user % 11 == 0, "")
        .otherwise(F.col("dataset"))
        .alias("dataset"),
        "timestamp",
        "user",
        day.alias("import_from"),
        F.date_add(day, (user % 5 - 1).cast("int")).alias("import_to"),
        day.alias("view_from"),
        F.date_add(day, (user % 7 - 1).cast("int")).alias("view_to"),
        day.alias("raw_from"),
        F.date_add(day, F.when(user % 13 == 0, 1).otherwise(0)).alias("raw_to"),
        pick(4, "8:05", "08:00", "xx", "22:15").alias("raw_start"),
        pick(6, "14:00", "14:01", None, "25:00", "9:30", "23:59").alias("raw_end"),
    )
