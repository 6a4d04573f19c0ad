"""Plays from tables and datasets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playlog.functions.days import Day, day_range
from playlog.functions.keys import within_days
from playlog.schema import MINUTES_TYPE, OLDER_NAMES, PLAYS


def play_source(spark: SparkSession, table: str) -> DataFrame:
    """The day-partitioned source table, to be filtered before use."""
    return spark.table(table)


def load_plays(
    spark: SparkSession,
    path: str,
    start: Day | None = None,
    end: Day | None = None,
    view: str | None = None,
    cache: bool = False,
) -> DataFrame:
    """A stored dataset as a text-keyed plays frame, optionally cut to a range of days.

    With ``view`` the frame is registered under that name, replacing what the name stood for before; with ``cache``
    the view is kept in memory (and on disk) from its first use on. Caching is off by default: an uncached frame lets filters
    and column picks reach the scan. A cached one is kept in order of time, by ranges of it, so that a later range of days
    skips the batches, and a window of minutes most of them, by their smallest and largest keys.
    """
    plays = conform(spark.read.parquet(path))
    if start is not None or end is not None:
        plays = within_days(plays, *day_range(start or "0001-01-01", end or "9999-12-31"))
    if cache and view is None:
        raise ValueError("caching needs a view name, so that the next load can replace it")
    if view is not None:
        if spark.catalog.tableExists(view) and spark.catalog.isCached(view):
            spark.catalog.uncacheTable(view)
        if cache:
            plays = plays.repartitionByRange("ymd", "ymdhm").sortWithinPartitions("ymd", "ymdhm")
        plays.createOrReplaceTempView(view)
        if cache:
            spark.catalog.cacheTable(view, StorageLevel.MEMORY_AND_DISK)
        plays = spark.table(view)
    return plays


def load_groups(spark: SparkSession, paths: Sequence[str], start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Groups of files, each of one layout, as one text-keyed plays frame, optionally cut to a range of days.

    A group may have the measure under its older name, and minutes as whole numbers, decimals of any width, or floating. All
    are widened to the narrowest decimal that holds each of them; with a floating group, or past 38 digits, to double.
    """
    groups = [load_plays(spark, path, start, end) for path in paths]
    kinds = [group.schema["minsplayed"].dataType for group in groups]
    kind = reduce(wider_minutes, kinds)
    widened = [group.withColumn("minsplayed", F.col("minsplayed").cast(kind)) for group in groups]
    return reduce(DataFrame.unionByName, widened)


_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}


def wider_minutes(one: T.DataType, other: T.DataType) -> T.DataType:
    """The narrowest type that holds the minutes of two."""
    if one == other:
        return one
    shapes = []
    for kind in (one, other):
        if isinstance(kind, T.DecimalType):
            shapes.append((kind.precision - kind.scale, kind.scale))
        elif kind in _DIGITS:
            shapes.append((_DIGITS[kind], 0))
        else:
            return T.DoubleType()
    whole, scale = (max(own) for own in zip(*shapes, strict=True))
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()


def present_names(stored: DataFrame) -> DataFrame:
    """A stored frame with its measure under the present name; where files of both layouts were merged, from either."""
    for name, older in OLDER_NAMES.items():
        if older in stored.columns and name not in stored.columns:
            stored = stored.withColumnRenamed(older, name)
        elif older in stored.columns:
            kind = wider_minutes(*(stored.schema[column].dataType for column in (name, older)))
            stored = stored.withColumn(name, F.coalesce(F.col(name).cast(kind), F.col(older).cast(kind))).drop(older)
    return stored


def conform(stored: DataFrame) -> DataFrame:
    """Check a stored frame against the plays schema and return its columns in that form.

    A day key read from folder names arrives as a date (or as void, where no play has a day) and becomes text again;
    filters on it still prune partitions.
    The measure may have its older name. Minutes keep their width when they are whole numbers or decimals; floating ones stay
    doubles, and are summed as such: the last digits of their sums depend on the order of the rows.
    """
    stored = present_names(stored)
    missing = [name for name in PLAYS.fieldNames() if name not in stored.columns]
    if missing:
        raise ValueError(f"not a plays dataset, columns missing: {', '.join(missing)}")
    columns = []
    for field in PLAYS.fields:
        found = stored.schema[field.name].dataType
        column = F.col(field.name)
        if field.name == "minsplayed":
            if not isinstance(found, T.NumericType):
                raise ValueError(f"not a plays dataset, minsplayed is {found.simpleString()}")
            if isinstance(found, T.FractionalType) and not isinstance(found, T.DecimalType):
                column = column.cast("double")
        elif not isinstance(found, (T.StringType, T.DateType, T.IntegralType, T.NullType)):
            raise ValueError(f"not a plays dataset, {field.name} is {found.simpleString()}")
        elif not isinstance(found, T.StringType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return stored.select(columns)


def exact_minutes(value: Column) -> Column:
    """A floating value as a decimal. One that has no equal among them fails; none is rounded or lost."""
    exact = value.try_cast(MINUTES_TYPE)
    wrong = F.raise_error(F.concat(F.lit(f"minutes that are no {MINUTES_TYPE.simpleString()}: "), value.cast("string")))
    return F.when(value.isNull() | (exact.cast("double") == value), exact).otherwise(wrong.cast(MINUTES_TYPE))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``events`` that plays come from. With the schema given, no file is opened to plan a query."""
    schema = "ts timestamp_ntz, user_id bigint, event_type string, value double"
    return spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet")


def read_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``lineitem`` that plays come from."""
    schema = "l_suppkey bigint, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
    return spark.read.schema(schema).parquet(f"{sf_dir}/lineitem.parquet")


def events_plays(spark: SparkSession, sf_dir: str, customer: str | None = None) -> DataFrame:
    """The ``events`` table as plays; a customer given here is filtered on the stored key and reaches the scan."""
    events = read_events(spark, sf_dir)
    if customer is not None:
        events = events.where(F.col("user_id") == F.lit(int(customer)))
    return events.select(
        F.col("user_id").cast("string").alias("customerID"),
        F.col("event_type").alias("genre"),
        exact_minutes(F.col("value")).alias("minsplayed"),
        "ts",
    )


def lineitem_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table as plays over several years."""
    return read_lineitem(spark, sf_dir).select(
        F.col("l_suppkey").cast("string").alias("customerID"),
        F.col("l_returnflag").alias("genre"),
        exact_minutes(F.col("l_quantity")).alias("minsplayed"),
        F.col("l_shipdate").alias("ts"),
    )
