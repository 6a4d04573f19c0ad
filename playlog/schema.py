"""The play-log data model.

A *plays* frame comes in one of two shapes, and every operator takes both:

* timestamped - ``customerID, genre, minsplayed, ts``; the text keys are derived from ``ts`` on demand;
* text-keyed  - ``customerID, genre, minsplayed`` and the stored text keys below, as in a written dataset.

A source table may carry the partition columns ``year, month, day`` as well.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The text keys are the leading characters of "yyyy-MM-dd HH:mm".
TEXT_KEYS = {"ym": 7, "ymd": 10, "ymdh": 13, "ymdhm": 16}

# Columns a raw export may pick, and its default pick.
EXPORT_COLUMNS = ["customerID", "genre", "minsplayed", "ym", "ymd", "ymdh", "ymdhm"]
DEFAULT_EXPORT = ["customerID", "genre", "minsplayed"]

PARTITION_COLUMNS = ["year", "month", "day"]

MINUTES_TYPE = T.DecimalType(18, 2)

PLAYS = T.StructType(
    [
        T.StructField("customerID", T.StringType()),
        T.StructField("ym", T.StringType()),
        T.StructField("ymd", T.StringType()),
        T.StructField("ymdh", T.StringType()),
        T.StructField("ymdhm", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("minsplayed", MINUTES_TYPE),
    ]
)

# The name that the measure had in an older layout, by its present one.
OLDER_NAMES = {"minsplayed": "minutes_played"}

# Headers of the two append-only logs.
REQUEST_LOG = ["timestamp", "user", "email", "customerID", "from", "to"]
READ_LOG = ["timestamp", "user", "datasetID", "from", "to"]
