"""Extraction as a job: one request in, a dataset and a report out.

    python -m playlog.plans.job --source plays --root /data/store --customerID 0612 \\
        --start 20190401 --end 20190430 --dataset user20190501080000
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from playlog.functions.days import Day, day_range
from playlog.messages import REQUEST_REJECTED
from playlog.operators.extract import batch_extract, customer_extract, extract_report
from playlog.operators.validate import checked_requests
from playlog.session import use_utc
from playlog.sinks.datasets import write_dataset
from playlog.sinks.store import publish
from playlog.sources import store
from playlog.sources.plays import play_source


def extract_dataset(source: DataFrame, root: str, dataset: str, customer: str, start: Day, end: Day) -> DataFrame:
    """Write the dataset of one request, if it has plays, and return its report, counted from what was written."""
    first, last = day_range(start, end)
    plays = customer_extract(source, customer, first, last)
    spark = source.sparkSession
    request = spark.range(1).select(
        F.lit(dataset).alias("dataset"),
        F.lit(str(customer)).alias("customerID"),
        F.lit(first).alias("from"),
        F.lit(last).alias("to"),
    )
    # The source is scanned once: the rows are counted while they are written, of which there may be none.
    seen = Observation()
    path = write_dataset(plays, root, dataset, seen=seen)
    n_rows = int(seen.get.get("n_rows") or 0)
    if not n_rows:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    counts = spark.range(1).select(F.lit(dataset).alias("dataset"), F.lit(n_rows).cast("bigint").alias("n_rows"))
    return extract_report(request, counts)


def extract_batch(source: DataFrame, requests: DataFrame, root: str, commit: str) -> DataFrame:
    """Publish the datasets of a batch of requests as one commit of a store, and return a report with a status for each.

    ``dataset, customerID, n_rows, status, subject, message``: a request that can't be taken is ``rejected`` with its
    reason and does not keep the others from being served; one without plays is ``empty`` and in the store nevertheless.
    The source is scanned once, and the report is made from what was written. A batch that failed is run again under the
    same commit id; one that was published is only reported again.
    """
    spark = source.sparkSession
    others = store.manifest(spark, root).where(F.col("commit") != F.lit(commit)).select("dataset").distinct()
    checked = checked_requests(requests, others)
    taken = checked.where("error IS NULL").drop("error")
    publish(batch_extract(source, taken), root, commit, taken)
    written = store.manifest(spark, root).where(F.col("commit") == F.lit(commit))
    counts = written.groupBy("dataset").agg(F.sum("n_rows").alias("n_rows"))
    status = F.when(F.col("n_rows") > 0, "ready").otherwise("empty")
    columns = ["dataset", "customerID", "n_rows", "status", "subject", "message"]
    served = extract_report(taken, counts).withColumn("status", status).select(columns)
    refused = checked.where("error IS NOT NULL").select(
        "dataset",
        "customerID",
        F.lit(0).cast("bigint").alias("n_rows"),
        F.lit("rejected").alias("status"),
        F.lit(REQUEST_REJECTED).alias("subject"),
        F.col("error").alias("message"),
    )
    return served.unionByName(refused)


def main(arguments: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(description="Extract the plays of a customer and a range of days.")
    for name in ("source", "root", "customerID", "start", "end", "dataset"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args(arguments)
    spark = use_utc(SparkSession.builder.appName("playlog-extract").getOrCreate())
    report = extract_dataset(
        play_source(spark, args.source), args.root, args.dataset, args.customerID, args.start, args.end
    )
    row = report.first()
    text = f"{row['subject']} {row['message']}"
    print(text)
    return text


if __name__ == "__main__":
    main()
