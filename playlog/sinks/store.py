"""Writing to a store with a manifest: publish a batch of datasets, rerun a failed batch, pack small files.

A commit is published in one step. Its plays and their manifest are written first, where no reader looks, and counted
while they are written; then one row is added that names the commit. A job that is lost before leaves nothing that a
reader sees, and running it again under the same commit id starts over; run again after it was published, it
changes nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from playlog.sinks.datasets import stored
from playlog.sources.store import commits, dataset_listing, drift, manifest, published

_COMMIT = re.compile(r"[A-Za-z0-9._-]+")
# Rows of a packed file. A task sorts the rows of a file, some 200 bytes each, whatever they are compressed to.
FILE_ROWS = 2_000_000


class StoreError(ValueError):
    """A commit that a store can't take."""


def _write_data(rows: DataFrame, path: str, commit: str, max_records: int) -> int:
    """Write the plays of a commit, in place of what a failed run left, and return how many they are."""
    seen = Observation(f"store-{commit}")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"))
    rows.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", max_records).parquet(path)
    return int(seen.get.get("n_rows") or 0)


def _entries(spark: SparkSession, path: str, n_rows: int) -> DataFrame:
    """The manifest of the files of a commit: only three narrow columns of them are read."""
    name = "dataset string, customerID string, ymd string"
    schema = f"{name}, file string, file_bytes bigint, n_rows bigint"
    if not n_rows:
        return spark.createDataFrame([], schema)
    plays = spark.read.schema(name).parquet(path)
    plays = plays.select("dataset", "customerID", "ymd", "_metadata.file_name", "_metadata.file_size")
    counted = plays.groupBy("file_name", "file_size", "dataset", "customerID", "ymd").agg(F.count("*").alias("n_rows"))
    return counted.select("dataset", "customerID", "ymd", F.col("file_name").alias("file"), F.col("file_size").alias("file_bytes"), "n_rows")


def _publish(
    spark: SparkSession, root: str, commit: str, rows: DataFrame, datasets: DataFrame | None, replaces: list[str], max_records: int
) -> str:
    """Write a commit and make it visible. ``rows`` are dealt out and sorted as they shall lie."""
    base = root.rstrip("/")
    n_rows = _write_data(rows, f"{base}/data/commit={commit}", commit, max_records)
    entries = _entries(spark, f"{base}/data/commit={commit}", n_rows)
    if datasets is not None:
        empty = datasets.select("dataset").distinct().join(entries.select("dataset").distinct(), "dataset", "left_anti")
        entries = entries.unionByName(empty.withColumn("n_rows", F.lit(0).cast("bigint")), allowMissingColumns=True)
    written = f"{base}/manifest/commit={commit}"
    entries.hint("rebalance").write.mode("overwrite").parquet(written)
    found = spark.read.schema(entries.schema).parquet(written).agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows")).first()
    if (found["n_rows"] or 0) != n_rows:
        raise StoreError(f"{n_rows} plays were written and {found['n_rows']} found: commit {commit} is not published")
    marker = spark.range(1).select(
        F.lit(n_rows).cast("bigint").alias("n_rows"),
        F.lit(found["n"]).cast("bigint").alias("n_entries"),
        F.array(*map(F.lit, replaces)).cast("array<string>").alias("replaces"),
    )
    # One file, which appears with its rename, whole or not at all.
    marker.coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/commit={commit}")
    return root


def _checked(spark: SparkSession, root: str, commit: str) -> bool:
    """Whether a commit is still to be made. A commit id is part of a path."""
    if not _COMMIT.fullmatch(commit):
        raise StoreError(f"not a commit id: {commit!r}")
    return published(spark, root).where(F.col("commit") == F.lit(commit)).isEmpty()


def publish(
    extracts: DataFrame,
    root: str,
    commit: str,
    requests: DataFrame | None = None,
    append: bool = False,
    max_records: int = 0,
    tasks: int | None = None,
) -> str:
    """Publish a batch of datasets, plays led by ``dataset``, as one commit, and return the root.

    All datasets of ``requests`` are in the store afterwards, those without plays too. A dataset that is there already is an
    error, unless the commit is to ``append``. Rows are rebalanced on their dataset, so that a file has many small datasets, a
    large one many files, and sorted by dataset and minute; ``tasks`` asks for that many files instead. Repeating a commit that
    was published does nothing.
    """
    spark = extracts.sparkSession
    if not _checked(spark, root, commit):
        return root
    rows = stored(extracts)
    if not append:
        asked = rows.select("dataset") if requests is None else requests.select("dataset")
        there = dataset_listing(spark, root).select("dataset").join(asked.distinct(), "dataset", "left_semi").first()
        if there is not None:
            raise StoreError(f"the store has a dataset {there['dataset']!r}")
    order = ["dataset", "ymdhm" if "ymdhm" in rows.columns else "ymd"]
    rows = rows.repartition(tasks, "dataset") if tasks else rows.hint("rebalance", "dataset")
    return _publish(spark, root, commit, rows.sortWithinPartitions(*order), requests, [], max_records)


def small_commits(spark: SparkSession, root: str, target_bytes: int) -> DataFrame:
    """``commit, n_bytes, n_files, n_rows`` of the commits whose files are small: on average below half the target, in bytes
    and in rows."""
    entries = manifest(spark, root).where(F.col("file").isNotNull())
    files = entries.groupBy("commit", "file", "file_bytes").agg(F.sum("n_rows").alias("n_rows"))
    sizes = files.groupBy("commit").agg(
        F.sum("file_bytes").alias("n_bytes"), F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows")
    )
    few_bytes = F.col("n_bytes") < F.col("n_files") * (target_bytes / 2)
    return sizes.where(few_bytes & (F.col("n_rows") < F.col("n_files") * (FILE_ROWS / 2)))


def pack(spark: SparkSession, root: str, commit: str, target_bytes: int = 256 << 20) -> list[str]:
    """Rewrite the commits with small files as one commit with files of about the target size; return what was replaced.

    Where plays are compressed so well that a file of that size has over ``FILE_ROWS`` rows, files have about so many rows.
    Commits whose files are large enough stay as they are, file by file. Readers see either the old commits or the new
    one. The commits, one row each, come to the driver, never their files or plays.
    """
    if not _checked(spark, root, commit):
        return []
    small = small_commits(spark, root, target_bytes).orderBy("commit").collect()
    if len(small) < 2 and sum(row["n_files"] for row in small) < 2:
        return []
    names = [row["commit"] for row in small]
    data = f"{root.rstrip('/')}/data"
    plays = spark.read.parquet(*[f"{data}/commit={name}" for name in names])
    order = ["dataset", next(name for name in ("ymdhm", "ymd") if name in plays.columns)]
    by_rows = math.ceil(sum(row["n_rows"] for row in small) / FILE_ROWS)
    files = max(1, round(sum(row["n_bytes"] for row in small) / target_bytes), by_rows)
    # By ranges of dataset and minute, so that a file is full, however its datasets are sized.
    plays = plays.repartitionByRange(files, *order).sortWithinPartitions(*order)
    known = manifest(spark, root).where(F.col("commit").isin(names)).select("dataset")
    _publish(spark, root, commit, plays, known, names, 0)
    return names


def leftovers(spark: SparkSession, root: str) -> list[str]:
    """Commits whose files no reader uses: those that failed, and those that were replaced."""
    live = {row["commit"] for row in commits(spark, root).select("commit").collect()}
    unknown = drift(spark, root).where("state = 'unknown'").select("commit").distinct().collect()
    return sorted({row["commit"] for row in unknown} - live)
