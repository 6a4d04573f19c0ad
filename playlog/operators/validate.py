"""Checks of what people typed, as one pass over a table of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.functions.days import parse_minute
from playlog.messages import (
    DATASET_EXISTS,
    DATASET_REPEATED,
    DATES_INVALID,
    DATES_REVERSED,
    END_INVALID,
    NO_CUSTOMER,
    NO_DATASET,
    NOT_FOUND,
    RANGE_TOO_LONG,
    START_INVALID,
)
from playlog.operators.extract import typed_requests

ERRORS = ["dataset_error", "import_error", "view_error", "range_error", "start_error", "end_error"]


def with_known(inputs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Inputs with ``known``: whether their dataset is in the listing. Inputs are kept whole.

    Inputs without a dataset, of which there may be many, stay out of the join.
    """
    listed = datasets.select("dataset").distinct().withColumn("known", F.lit(True))
    named = F.coalesce(F.col("dataset") != "", F.lit(False))
    joined = inputs.where(named).join(listed, "dataset", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return joined.unionByName(inputs.where(~named).withColumn("known", F.lit(False)))


def validate_requests(inputs: DataFrame, datasets: DataFrame) -> DataFrame:
    """One message column per rule, null where the rule holds, and ``valid``.

    ``inputs`` has ``dataset``, the dates ``import_from, import_to, view_from, view_to, raw_from, raw_to`` and the
    typed times ``raw_start, raw_end``.
    """
    start = parse_minute(F.col("raw_from"), F.col("raw_start"))
    end = parse_minute(F.col("raw_to"), F.col("raw_end"))
    checked = with_known(inputs, datasets).withColumns({"_start": start, "_end": end})
    rules = {
        "dataset_error": F.when((F.col("dataset") != "") & ~F.col("known"), NOT_FOUND),
        "import_error": F.when(F.col("import_to") < F.col("import_from"), DATES_REVERSED),
        "view_error": F.when(F.col("view_to") < F.col("view_from"), DATES_REVERSED),
        "range_error": F.when(F.col("_end") - F.col("_start") > F.expr("INTERVAL '6' HOUR"), RANGE_TOO_LONG),
        "start_error": F.when(F.col("_start").isNull(), START_INVALID),
        "end_error": F.when(F.col("_end").isNull(), END_INVALID),
    }
    return (
        checked.withColumns(rules)
        .withColumn("valid", F.coalesce(*ERRORS).isNull())
        .select(*inputs.columns, *ERRORS, "valid")
    )


def accepted_reads(inputs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Inputs that may be loaded: their dataset is listed and their import dates are in order."""
    listed = datasets.select("dataset").distinct()
    loadable = inputs.where((F.col("dataset") != "") & (F.col("import_from") <= F.col("import_to")))
    return loadable.join(listed, "dataset", "left_semi").select(*inputs.columns)


def checked_requests(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """Requests with their dates as dates and an ``error``: why one can't be taken, null where it can.

    Taken are requests with a dataset ID that no other request has and that is not in ``datasets`` yet, a customer, and two
    dates in order. All requests of a repeated ID are refused, as none of them can be told to be the right one.
    """
    requests = typed_requests(requests)
    repeated = requests.groupBy("dataset").agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = repeated.select("dataset", F.lit(True).alias("_repeated"))
    marked = with_known(requests, datasets).join(repeated, "dataset", "left")
    error = (
        F.when(F.coalesce(F.col("dataset"), F.lit("")) == "", NO_DATASET)
        .when(F.coalesce(F.col("customerID"), F.lit("")) == "", NO_CUSTOMER)
        .when(F.col("from").isNull() | F.col("to").isNull(), DATES_INVALID)
        .when(F.col("to") < F.col("from"), DATES_REVERSED)
        .when(F.col("_repeated"), DATASET_REPEATED)
        .when(F.col("known"), DATASET_EXISTS)
    )
    return marked.select(*[F.col(f"`{name}`") for name in requests.columns], error.alias("error"))
