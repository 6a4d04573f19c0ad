"""The store with a manifest: publishing, failed commits, packing, drift, coverage, batches of requests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import plan, timestamped, values
from playlog.messages import DATASET_EXISTS, DATASET_REPEATED, DATES_INVALID, DATES_REVERSED, NO_CUSTOMER, NO_DATASET
from playlog.operators import extract
from playlog.plans.job import extract_batch
from playlog.sinks import store as sink
from playlog.sinks.store import StoreError, pack, publish
from playlog.sources import store

ROWS = [
    ("612", "news", "1.50", "2024-01-08 00:00:00"),
    ("612", "film", "2.00", "2024-01-08 09:30:59"),
    ("612", None, None, "2024-01-10 23:59:59"),
]
MORE = [("7", "news", "4.00", "2024-01-09 12:00:00")]


def led(spark, rows, dataset):
    return timestamped(spark, rows).withColumn("dataset", F.lit(dataset))


def names(spark, *datasets):
    return spark.createDataFrame([(name,) for name in datasets], "dataset string")


def catalog(spark, root):
    return {row["dataset"]: tuple(row)[1:] for row in store.dataset_catalog(spark, root).collect()}


def test_publish_and_read(spark, tmp_path):
    root = str(tmp_path / "store+a")
    assert store.dataset_listing(spark, root).count() == 0 and catalog(spark, root) == {}
    batch = led(spark, ROWS, "ann 1/2").union(led(spark, MORE, "bob"))
    publish(batch, root, "2024", names(spark, "ann 1/2", "bob", "nobody"))
    assert catalog(spark, root) == {
        "ann 1/2": ("612", 3, 2, "2024-01-08", "2024-01-10"),
        "bob": ("7", 1, 1, "2024-01-09", "2024-01-09"),
        "nobody": (None, 0, 0, None, None),
    }
    listing = {row["dataset"]: (row["n_files"], row["n_bytes"] > 0) for row in store.dataset_listing(spark, root).collect()}
    assert listing == {"ann 1/2": (1, True), "bob": (1, True), "nobody": (0, False)}
    loaded = store.load_dataset(spark, root, "ann 1/2", "2024-01-09", "2024-01-31")
    assert [row["ymdhm"] for row in loaded.collect()] == ["2024-01-10 23:59"]
    assert store.load_dataset(spark, root, "nobody").count() == store.load_dataset(spark, root, "unknown").count() == 0
    assert store.drift(spark, root).count() == 0
    assert values(store.store_minutes(spark, root).orderBy("dataset")) == [("ann 1/2", 3.5, 3), ("bob", 4.0, 1)]


def test_datasets_are_not_replaced(spark, tmp_path):
    root = str(tmp_path)
    publish(led(spark, ROWS, "a"), root, "one")
    with pytest.raises(StoreError, match="'a'"):
        publish(led(spark, MORE, "a"), root, "two")
    publish(led(spark, MORE, "a"), root, "two", append=True)
    assert catalog(spark, root)["a"][1] == 4
    # A commit that was published is not made again, whatever it would hold.
    publish(led(spark, ROWS * 5, "b"), root, "two", append=True)
    assert set(catalog(spark, root)) == {"a"}
    for wrong in ("", "a/b", "x y", "../z"):
        with pytest.raises(StoreError, match="commit id"):
            publish(led(spark, MORE, "c"), root, wrong)


@pytest.mark.parametrize("step", ["_write_data", "_entries", "marker"])
def test_a_commit_that_fails_midway(spark, tmp_path, monkeypatch, step):
    """What a lost driver leaves is seen by no reader, and the same commit can be made again."""
    root = str(tmp_path)
    publish(led(spark, MORE, "first"), root, "one")

    class Lost(Exception):
        pass

    with monkeypatch.context() as patch:
        if step == "marker":
            original = sink._entries

            def fewer(*args):
                return original(*args).limit(1)

            patch.setattr(sink, "_entries", fewer)
            expected = StoreError
        else:
            original = getattr(sink, step)

            def lost(*args):
                if step == "_write_data":
                    original(*args)
                raise Lost

            patch.setattr(sink, step, lost)
            expected = Lost
        with pytest.raises(expected):
            publish(led(spark, ROWS, "second"), root, "two")
    assert set(catalog(spark, root)) == {"first"}
    assert store.load_dataset(spark, root, "second").count() == 0
    assert {(row["commit"], row["state"]) for row in store.drift(spark, root).collect()} == {("two", "unknown")}
    assert sink.leftovers(spark, root) == ["two"]
    publish(led(spark, ROWS, "second"), root, "two")
    assert catalog(spark, root)["second"] == ("612", 3, 2, "2024-01-08", "2024-01-10")
    assert store.drift(spark, root).count() == 0 and sink.leftovers(spark, root) == []


def test_drift_names_files(spark, tmp_path):
    publish(led(spark, ROWS, "a"), str(tmp_path), "one")
    publish(led(spark, MORE, "b"), str(tmp_path), "two")
    (gone,) = (tmp_path / "data" / "commit=one").glob("*.parquet")
    (longer,) = (tmp_path / "data" / "commit=two").glob("*.parquet")
    (tmp_path / "data" / "commit=two" / "more.parquet").write_bytes(gone.read_bytes())
    gone.unlink()
    longer.write_bytes(longer.read_bytes() + b"x")
    found = {(row["commit"], row["file"]): row["state"] for row in store.drift(spark, str(tmp_path)).collect()}
    assert found == {("one", gone.name): "missing", ("two", longer.name): "resized", ("two", "more.parquet"): "unknown"}


def test_packing_takes_small_files_only(spark, tmp_path):
    root = str(tmp_path)
    for number in range(3):
        publish(led(spark, ROWS[number : number + 1], "a"), root, f"small-{number}", names(spark, "a", "none"), append=True)
    many = spark.range(60_000).select(
        F.lit("612").alias("customerID"),
        F.sha2(F.col("id").cast("string"), 256).alias("genre"),
        F.lit(1).cast("decimal(18,2)").alias("minsplayed"),
        F.lit("2024-01-05 10:00:00").cast("timestamp_ntz").alias("ts"),
        F.lit("large").alias("dataset"),
    )
    publish(many, root, "large", tasks=1)
    before, kept = catalog(spark, root), sorted((tmp_path / "data" / "commit=large").glob("*.parquet"))
    assert pack(spark, root, "packed", target_bytes=1 << 20) == ["small-0", "small-1", "small-2"]
    assert catalog(spark, root) == before
    assert sorted((tmp_path / "data" / "commit=large").glob("*.parquet")) == kept
    assert {row["commit"] for row in store.commits(spark, root).collect()} == {"large", "packed"}
    listing = {row["dataset"]: row["n_files"] for row in store.dataset_listing(spark, root).collect()}
    assert listing == {"a": 1, "none": 0, "large": 1}
    assert sorted(row["ymd"] for row in store.load_dataset(spark, root, "a").collect()) == ["2024-01-08", "2024-01-08", "2024-01-10"]
    assert store.load_dataset(spark, root, "a", "2024-01-10", "2024-01-10").count() == 1
    assert sink.leftovers(spark, root) == ["small-0", "small-1", "small-2"]
    assert pack(spark, root, "packed", target_bytes=1 << 20) == pack(spark, root, "again", target_bytes=100) == []


def test_packed_files_have_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FILE_ROWS", 500, raising=False)
    root = str(tmp_path)
    for number in range(2):
        plays = spark.range(1_000).select(
            (F.col("id") % 7).cast("string").alias("customerID"),
            F.lit("g").alias("genre"),
            F.lit(1).cast("decimal(18,2)").alias("minsplayed"),
            F.timestamp_seconds(1_704_700_000 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
            F.lit("all").alias("dataset"),
        )
        publish(plays, root, f"part-{number}", append=True, max_records=100)
    assert pack(spark, root, "packed") == ["part-0", "part-1"]
    files = store.manifest(spark, root).groupBy("file").agg(F.sum("n_rows").alias("n")).collect()
    assert sum(row["n"] for row in files) == 2_000 and len(files) == 4
    assert max(row["n"] for row in files) < 1_000
    # Files with so many rows are not small, whatever their bytes.
    assert pack(spark, root, "again") == []


def test_coverage_reads_no_plays(spark, tmp_path):
    root = str(tmp_path)
    publish(led(spark, ROWS, "all"), root, "1", append=True)
    publish(led(spark, ROWS[:1] + MORE, "all"), root, "2", append=True)
    requests = spark.createDataFrame(
        [("r1", "612", "20240107", "20240110"), ("r2", "7", "2024-01-09", "2024-01-09"), ("r3", "x", "20240101", "20240101")],
        "dataset string, customerID string, from string, to string",
    )
    plays = timestamped(spark, ROWS + ROWS[:1] + MORE)
    found = store.known_coverage(requests, store.manifest(spark, root))
    assert sorted(values(found)) == sorted(values(extract.batch_coverage(plays, requests)))
    assert "/manifest" in plan(found) and "/data" not in plan(found)


def test_a_batch_with_bad_requests(spark, tmp_path):
    source = timestamped(spark, ROWS + MORE)
    publish(led(spark, MORE, "old"), str(tmp_path), "before")
    requests = spark.createDataFrame(
        [
            ("good", "612", "2024-01-08", "2024-01-09"),
            ("empty", "612", "20230101", "20230102"),
            ("back", "612", "2024-01-09", "2024-01-08"),
            ("date", "612", "2024-02-30", "2024-03-01"),
            ("twice", "612", "2024-01-08", "2024-01-08"),
            ("twice", "7", "2024-01-08", "2024-01-08"),
            ("old", "7", "2024-01-08", "2024-01-09"),
            ("who", None, "2024-01-08", "2024-01-09"),
            (None, "612", "2024-01-08", "2024-01-09"),
        ],
        "dataset string, customerID string, from string, to string",
    )
    for _ in range(2):
        report = extract_batch(source, requests, str(tmp_path), "batch")
        found = sorted((row["dataset"] or "", row["n_rows"], row["status"], row["message"]) for row in report.collect())
        assert found == sorted(
            [
                ("good", 2, "ready", "Customer 612, 08/01/2024 - 09/01/2024: the data are available under dataset ID good."),
                ("empty", 0, "empty", found[[x[0] for x in found].index("empty")][3]),
                ("back", 0, "rejected", DATES_REVERSED),
                ("date", 0, "rejected", DATES_INVALID),
                ("twice", 0, "rejected", DATASET_REPEATED),
                ("twice", 0, "rejected", DATASET_REPEATED),
                ("old", 0, "rejected", DATASET_EXISTS),
                ("who", 0, "rejected", NO_CUSTOMER),
                ("", 0, "rejected", NO_DATASET),
            ]
        )
    assert set(catalog(spark, str(tmp_path))) == {"old", "good", "empty"}


def test_an_empty_batch(spark, tmp_path):
    none = spark.createDataFrame([], "dataset string, customerID string, from string, to string")
    report = extract_batch(timestamped(spark, ROWS), none, str(tmp_path), "batch")
    assert report.count() == 0 and catalog(spark, str(tmp_path)) == {}
