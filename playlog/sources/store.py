"""A store of many datasets in shared files, known by its manifest.

A folder per dataset makes as many files as there are requests. Here the plays of a batch of datasets lie together in files
of a good size, sorted by dataset, and what a dataset consists of is told by tables:

* ``data/commit=<id>/``     - plays with their ``dataset``, written by one commit;
* ``manifest/commit=<id>/`` - for each dataset, file, customer and day of a commit, the number of plays; a dataset without
  plays has one row without a file;
* ``commits/commit=<id>/``  - one row per commit, written last: a commit that has none is not there for any reader.

A commit may replace others, which are then no longer read. Everything a catalogue, a listing, a check or a coverage needs
is in the manifest, which has a row per dataset and day and not per play: no folder is listed on the driver and no plays are read.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.functions.days import Day, day_range
from playlog.functions.keys import within_days
from playlog.functions.minutes import shown, sum_minutes
from playlog.operators.extract import request_days
from playlog.schema import PLAYS

MANIFEST = "commit string, dataset string, file string, file_bytes bigint, customerID string, ymd string, n_rows bigint"
COMMITS = "commit string, n_rows bigint, n_entries bigint, replaces array<string>"


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _path(spark, path)
    return files.exists(place)


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{name}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    # The folder a file lies in is part of the table.
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def published(spark: SparkSession, root: str) -> DataFrame:
    """``commit, n_rows, n_entries, replaces`` of all commits that were ever published."""
    return _table(spark, root, "commits", COMMITS)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """``commit, n_rows, n_entries, replaces`` of the commits that are published and not replaced."""
    found = published(spark, root)
    replaced = found.select(F.explode("replaces").alias("commit")).distinct()
    return found.join(replaced, "commit", "left_anti")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``commit, dataset, file, file_bytes, customerID, ymd, n_rows`` of all commits that are read."""
    entries = _table(spark, root, "manifest", MANIFEST)
    return entries.join(commits(spark, root).select("commit"), "commit", "left_semi")


def dataset_listing(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset, also those without plays, with its number of files and its bytes.

    A file shared by several datasets counts for each of them with the share it has of the file's plays.
    """
    entries = manifest(spark, root).groupBy("dataset", "commit", "file", "file_bytes").agg(F.sum("n_rows").alias("own"))
    totals = entries.where(F.col("file").isNotNull()).groupBy("commit", "file").agg(F.sum("own").alias("all"))
    shared = entries.join(totals, ["commit", "file"], "left")
    own = F.floor(F.col("file_bytes") * (F.col("own") / F.col("all")))
    return shared.groupBy("dataset").agg(
        F.count("file").alias("n_files"), F.coalesce(F.sum(own), F.lit(0).cast("bigint")).alias("n_bytes")
    )


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset: customer, rows, days with data, first and last day; a dataset without plays has 0 rows."""
    # Summed by customer first: a minimum of text makes Spark sort, and this leaves it few rows.
    counted = manifest(spark, root).groupBy("dataset", "ymd", "customerID").agg(F.sum("n_rows").alias("n"))
    days = counted.groupBy("dataset", "ymd").agg(F.sum("n").alias("n"), F.min("customerID").alias("customerID"))
    return days.groupBy("dataset").agg(
        F.min("customerID").alias("customerID"),
        F.sum("n").alias("n_rows"),
        F.count("ymd").alias("n_days"),
        F.min("ymd").alias("first_day"),
        F.max("ymd").alias("last_day"),
    )


def load_dataset(
    spark: SparkSession, root: str, dataset: str, start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """A dataset as a text-keyed plays frame, optionally cut to a range of days.

    Only files that the manifest names for the dataset and the range are opened; in them, row groups of other datasets
    are skipped by their statistics.
    """
    entries = manifest(spark, root).where((F.col("dataset") == F.lit(dataset)) & F.col("file").isNotNull())
    chosen = day_range(start or "0001-01-01", end or "9999-12-31") if start is not None or end is not None else None
    if chosen:
        entries = within_days(entries, *chosen)
    data = f"{root.rstrip('/')}/data"
    files = [f"{data}/commit={row['commit']}/{row['file']}" for row in entries.select("commit", "file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], PLAYS)
    plays = spark.read.option("mergeSchema", True).parquet(*files).where(F.col("dataset") == F.lit(dataset))
    plays = within_days(plays, *chosen) if chosen else plays
    return plays.select([F.col(field.name).cast(field.dataType) if field.name != "minsplayed" else F.col(field.name) for field in PLAYS])


def known_coverage(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``dataset, customerID, day, n_rows, has_data`` for every day of every request, from the entries of a manifest.

    The plays themselves are not read: the counts per customer and day were taken when they were written.
    """
    wanted = request_days(requests, "days")
    day = F.col("ymd").try_cast("date")
    number = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    sums = entries.select("customerID", number.alias("day_number"), "n_rows").groupBy("customerID", "day_number")
    sums = wanted.asked(sums.agg(F.sum("n_rows").alias("n")))
    n_rows = F.coalesce("n", F.lit(0).cast("bigint"))
    return wanted.days.join(sums, ["customerID", "day_number"], "left").select(
        "dataset", "customerID", F.col("request_day").alias("day"), n_rows.alias("n_rows"), (n_rows > 0).alias("has_data")
    )


def drift(spark: SparkSession, root: str) -> DataFrame:
    """``commit, file, state`` of every file that the manifest and the folder do not agree on.

    ``missing`` is named by the manifest and not there, ``resized`` has another size, ``unknown`` is there and belongs to no
    commit that is read: what a failed or replaced commit left behind. Sizes come from the listing of files, by all tasks.
    """
    data = f"{root.rstrip('/')}/data"
    named = manifest(spark, root).where(F.col("file").isNotNull()).select("commit", "file", "file_bytes").distinct()
    if not exists(spark, data):
        there = spark.createDataFrame([], "commit string, file string, length bigint")
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(data)
        there = listed.select(
            F.regexp_extract("path", r"/commit=([^/]*)/[^/]*$", 1).alias("commit"),
            F.regexp_extract("path", r"([^/]*)$", 1).alias("file"),
            "length",
        )
    state = (
        F.when(F.col("length").isNull(), "missing")
        .when(F.col("file_bytes").isNull(), "unknown")
        .when(F.col("length") != F.col("file_bytes"), "resized")
    )
    joined = named.join(there, ["commit", "file"], "full").withColumn("state", state)
    return joined.where(F.col("state").isNotNull()).select("commit", "file", "state")


def store_minutes(spark: SparkSession, root: str) -> DataFrame:
    """``dataset, n_rows, minsplayed``: all datasets of a store summed in one scan."""
    data = f"{root.rstrip('/')}/data"
    # Given as text, a commit id that looks like a number stays as it is.
    found = spark.read.parquet(data).drop("commit").schema.add("commit", "string")
    plays = spark.read.schema(found).parquet(data).join(commits(spark, root).select("commit"), "commit", "left_semi")
    return shown(sum_minutes(plays, {"dataset": F.col("dataset")}, zero=False, count="n_rows"))
