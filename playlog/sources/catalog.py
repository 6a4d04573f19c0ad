"""What a dataset store holds.

A store is a folder of datasets, written either as ``<root>/dataset=<id>/...`` or as ``<root>/<id>/...``; inside, the
files may lie flat or in one folder per day.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEME = r"^(?:[^/:]+:(?://[^/]*)?)?"


# The characters Spark escapes in the name of a partition folder.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def dataset_path(root: str, dataset: str) -> str:
    """The folder of a dataset, named as by a write partitioned on ``dataset``."""
    name = _ESCAPED.sub(lambda match: f"%{ord(match[0]):02X}", dataset)
    return f"{root.rstrip('/')}/dataset={name}"


def _unescaped(text: Column) -> Column:
    """Text without its percent escapes. A plus sign, which is none, is kept."""
    return F.try_url_decode(F.regexp_replace(text, r"\+", "%2B"))


def _dataset_of(path: Column, root: str) -> Column:
    """The dataset named by the folder right below the root, from the full path of a file."""
    below = re.sub(_SCHEME, "", root.rstrip("/"))
    folder = F.regexp_extract(path, rf"{_SCHEME}\Q{below}\E/([^/]+)/", 1)
    # Spark escapes what a partition folder's name must not hold.
    value = _unescaped(F.regexp_extract(folder, "^dataset=(.*)$", 1))
    return F.when(folder.startswith("dataset="), value).otherwise(folder)


def _folders(spark: SparkSession, root: str) -> list[str] | None:
    """The names of the folders right below a root; none where there is no root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [entry.getPath().getName() for entry in files.listStatus(path) if entry.isDirectory()]
    return [name for name in names if not name.startswith(("_", "."))]


def dataset_listing(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset with its number of files and bytes, from the file listing alone: no file is opened.

    Every folder of the store is a dataset, an empty one too. A store that is not there lists nothing.
    """
    names = _folders(spark, root)
    folders = spark.createDataFrame([(name,) for name in names or []], "folder string")
    value = _unescaped(F.regexp_extract("folder", "^dataset=(.*)$", 1))
    listed = folders.select(F.when(F.col("folder").startswith("dataset="), value).otherwise(F.col("folder")).alias("dataset"))
    if not names:
        return listed.select("dataset", F.lit(0).cast("bigint").alias("n_files"), F.lit(0).cast("bigint").alias("n_bytes"))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select(_dataset_of(F.col("path"), root).alias("dataset"), "length")
    )
    found = files.groupBy("dataset").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
    counts = [F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in ("n_files", "n_bytes")]
    return listed.join(found, "dataset", "left").select("dataset", *counts)


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset: rows, days with data, first and last day, customer.

    Only the customer and day columns are read. Rows are counted per file, day and customer where they are read, so a
    dataset that holds most of the store is counted by all tasks. What works on text, taking paths apart and finding
    the least customer, sees those counts only: a minimum of text over plays would make Spark sort them.
    """
    plays = (
        spark.read.schema("customerID string, ymd string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
        .select(F.col("_metadata.file_path").alias("path"), "customerID", "ymd")
    )
    files = plays.groupBy("path", "ymd", "customerID").agg(F.count("*").alias("n"))
    # Unlike the path of a listing, this one is escaped as in an address.
    path = _unescaped(F.col("path"))
    day_folder = F.nullif(F.regexp_extract(path, r"/ymd=(\d{4}-\d{2}-\d{2})/", 1), F.lit(""))
    days = (
        files.select(
            _dataset_of(path, root).alias("folder"),
            F.coalesce("ymd", day_folder).alias("ymd"),
            "n",
            "customerID",
        )
        .groupBy("folder", "ymd")
        .agg(F.sum("n").alias("n"), F.min("customerID").alias("customerID"))
    )
    datasets = days.groupBy("folder").agg(
        F.max("folder").alias("dataset"),
        F.min("customerID").alias("customerID"),
        F.sum("n").alias("n_rows"),
        F.count("ymd").alias("n_days"),
        F.min("ymd").alias("first_day"),
        F.max("ymd").alias("last_day"),
    )
    # Files right below the root are no dataset. On the grouping column, the optimizer would move this test down to
    # every play.
    return datasets.where(F.col("dataset") != "").drop("folder")
