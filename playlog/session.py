"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, so that zoned timestamps read as the wall clock they were written with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# Bytes of rows handed to a Python worker at once: a little less than the blocks that operators work on.
BATCH_BYTES = 7 << 18


def use_small_batches(spark: SparkSession) -> SparkSession:
    """Bound what is handed to a Python worker at once by its bytes, as 10,000 long texts take tens of MB on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for written tables, below the shared folder the session names in ``spark.checkpoint.dir``.

    Only where that setting is missing and all runs in one process is a temporary folder of this machine used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="playlog-")
    return f"{base}/playlog-{name}-{uuid.uuid4().hex}"
