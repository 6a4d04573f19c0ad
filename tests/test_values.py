"""Values that must not get lost: minutes, moments and null texts, datasets without files."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from playlog.operators.aggregate import daily_minutes
from playlog.operators.validate import with_known
from playlog.plans.job import extract_dataset
from playlog.session import work_folder
from playlog.sinks.datasets import compact_dataset, write_dataset
from playlog.sinks.text import export_csv, read_csv
from playlog.sources.catalog import dataset_listing
from playlog.sources.plays import exact_minutes, load_plays

from helpers import plan, timestamped

KEYED = "customerID string, ym string, ymd string, ymdh string, ymdhm string, genre string, minsplayed double"


def _doubles(spark, values):
    return spark.createDataFrame(
        [("1", "2024-01", day, f"{day} 08", f"{day} 08:00", "g", value) for day, value in values], KEYED
    )


def test_floating_minutes_are_kept(spark, tmp_path):
    values = [("2024-01-01", 0.004), ("2024-01-01", 0.004), ("2024-01-02", 1e17), ("2024-01-03", math.nan)]
    _doubles(spark, values).write.parquet(str(tmp_path / "d"))
    sums = {str(row["Date"]): row["minsplayed"] for row in daily_minutes(load_plays(spark, str(tmp_path / "d")), "20240101", "20240103").collect()}
    assert math.isclose(sums["2024-01-01"], 0.008)
    assert sums["2024-01-02"] == 1e17
    assert math.isnan(sums["2024-01-03"])


def test_minutes_that_are_no_decimals_fail(spark):
    frame = spark.createDataFrame([(1.25,), (None,), (-3.0,)], "v double")
    assert [row[0] and float(row[0]) for row in frame.select(exact_minutes(F.col("v"))).collect()] == [1.25, None, -3.0]
    for bad in (0.004, 1e17, math.nan, math.inf):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "v double").select(exact_minutes(F.col("v"))).collect()


def test_moments_in_csv_keep_zone_and_fraction(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.sql(
            "SELECT timestamp'2024-01-01 08:00:00.123456' AS t, timestamp_ntz'2024-07-01 09:30:00.5' AS n, 'x;\"y' AS s"
            " UNION ALL SELECT timestamp'2024-11-03 01:30:00', timestamp_ntz'1960-01-01 00:00:00', null"
        )
        path = export_csv(frame, str(tmp_path / "csv"), files=1)
        lines = spark.read.text(path).toPandas()["value"].tolist()
        assert any(line.startswith("2024-01-01T13:00:00.123456Z;2024-07-01T09:30:00.5Z") for line in lines)
        back = read_csv(spark, path, "t timestamp, n timestamp_ntz, s string")
        assert sorted(map(repr, back.collect())) == sorted(map(repr, frame.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text_that_stands_for_null(spark, tmp_path):
    frame = spark.createDataFrame([("NA",), (None,)], "genre string")
    with pytest.raises(PySparkException):
        export_csv(frame, str(tmp_path / "bad"))
    path = export_csv(frame, str(tmp_path / "good"), null_text="\\N")
    assert {row[0] for row in read_csv(spark, path, "genre string", null_text="\\N").collect()} == {"NA", None}


def test_ordered_export(spark, tmp_path):
    path = export_csv(spark.range(100).repartition(5), str(tmp_path / "csv"), files=3, order=[F.desc("id")])
    parts = sorted(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")
    numbers = [int(line) for part in parts for line in part.read_text().split("\n")[1:] if line]
    assert len(parts) == 3 and numbers == sorted(range(100), reverse=True)
    assert path


def test_listing_of_empty_datasets_and_stores(spark, tmp_path):
    assert dataset_listing(spark, str(tmp_path / "none")).count() == 0
    root = tmp_path / "store"
    (root / "dataset=empty").mkdir(parents=True)
    (root / "plain").mkdir()
    write_dataset(timestamped(spark, [("1", "g", "1", "2024-01-01 08:00")]), str(root), "full")
    found = {row["dataset"]: row["n_files"] for row in dataset_listing(spark, str(root)).collect()}
    assert found == {"empty": 0, "plain": 0, "full": 1}
    inputs = spark.createDataFrame([("empty",), ("",), (None,), ("other",)], "dataset string")
    known = {row["dataset"]: row["known"] for row in with_known(inputs, dataset_listing(spark, str(root))).collect()}
    assert known == {"empty": True, "": False, None: False, "other": False}


def test_compacted_files_hold_ranges(spark, tmp_path):
    rows = [("1", "g", "1", f"2024-01-{day:02} 08:00") for day in range(1, 29) for _ in range(3)]
    source = write_dataset(timestamped(spark, rows), str(tmp_path), "d")
    target = compact_dataset(spark, source, str(tmp_path / "compact"), files=4)
    ranges = sorted(
        tuple(row)
        for row in spark.read.parquet(target)
        .groupBy(F.input_file_name())
        .agg(F.min("ymdhm").alias("first"), F.max("ymdhm").alias("last"))
        .select("first", "last")
        .collect()
    )
    assert len(ranges) == 4
    assert all(before[1] < after[0] for before, after in zip(ranges, ranges[1:], strict=False))


def test_job_scans_once(spark, tmp_path):
    source = timestamped(spark, [("1", "g", "1", "2024-01-01 08:00"), ("2", "g", "1", "2024-01-01 08:00")])
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    source = source.mapInArrow(counted, source.schema)
    report = extract_dataset(source, str(tmp_path), "d", "1", "20240101", "20240102").first()
    assert (report["n_rows"], scans.value) == (1, 2)
    report = extract_dataset(source, str(tmp_path), "e", "9", "20240101", "20240102").first()
    assert (report["n_rows"], scans.value) == (0, 4)
    assert not (tmp_path / "dataset=e").exists()


def test_minute_keys_are_grouped_as_integers(spark):
    from playlog.operators.aggregate import minute_minutes

    table = minute_minutes(timestamped(spark, [("1", "g", "1", "2024-01-01 08:05:59")]), "20240101", "20240101")
    assert [row["ymdhm"] for row in table.collect()] == ["2024-01-01 08:05"]
    assert "_minute" in plan(table)


def test_work_folder_must_be_shared(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError):
        work_folder(Cluster, "x")
