from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import SHAPES, plan, text_keyed, timestamped, values
from playlog.operators import extract
from playlog.plans.job import extract_dataset, main
from playlog.sinks.datasets import write_batch
from playlog.sources.catalog import dataset_catalog
from playlog.sources.plays import load_plays, play_source

D = dt.date
ROWS = [
    ("0612", "news", "1", "2024-01-08 00:00:00"),
    ("0612", "news", "2", "2024-01-10 23:59:59"),
    ("612", "news", "4", "2024-01-09 10:00:00"),
    ("612", "film", "8", "2024-01-10 10:00:00"),
    ("7", "film", "16", "2024-01-11 10:00:00"),
]


def requests_of(spark, rows):
    return spark.createDataFrame(rows, "dataset string, customerID string, from date, to date")


@pytest.mark.parametrize("shape", SHAPES)
def test_customer_ids_are_text(spark, shape):
    plays = shape(spark, ROWS)
    found = extract.customer_extract(plays, "0612", "20240108", "2024-01-10")
    assert found.columns == plays.columns
    assert sorted(row["minsplayed"] for row in found.collect()) == [1, 2]
    number = extract.customer_extract(plays, 612, "2024-01-08", "2024-01-09")
    assert [row["minsplayed"] for row in number.collect()] == [4]


@pytest.mark.parametrize("shape", SHAPES)
def test_coverage_has_every_day(spark, shape):
    coverage = extract.daily_coverage(shape(spark, ROWS), "0612", "2024-01-07", "2024-01-10")
    assert sorted(values(coverage)) == [
        (D(2024, 1, 7), 0, False),
        (D(2024, 1, 8), 1, True),
        (D(2024, 1, 9), 0, False),
        (D(2024, 1, 10), 1, True),
    ]
    empty = extract.daily_coverage(shape(spark, ROWS), "none", "2024-01-07", "2024-01-08")
    assert sorted(values(empty)) == [(D(2024, 1, 7), 0, False), (D(2024, 1, 8), 0, False)]


def test_day_extracts_merge_to_the_range(spark):
    plays = timestamped(spark, ROWS)
    days = [extract.customer_extract(plays, "612", f"2024-01-{d:02d}", f"2024-01-{d:02d}") for d in (8, 9, 10)]
    whole = extract.customer_extract(plays, "612", "2024-01-08", "2024-01-10")
    assert Counter(values(extract.merge_days(*days))) == Counter(values(whole))


def test_dataset_id_has_the_full_time(spark):
    row = spark.sql("select 'ann' as user, timestamp_ntz'2024-01-10 08:05:09.5' as at")
    assert values(row.select(extract.dataset_id(F.col("user"), F.col("at")))) == [("ann20240110080509",)]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """As with a request table too large to broadcast."""
    monkeypatch.setattr(extract, "BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def random_batch(spark, shape):
    pick = random.Random(7)
    first = dt.datetime(2024, 1, 1)
    # One customer holds a good third of the plays, and of the requests.
    plays = [
        (
            pick.choice(["hot", "a", "b"]),
            pick.choice("xyz"),
            str(pick.randint(0, 99)),
            str(first + dt.timedelta(minutes=pick.randint(0, 40_000))),
        )
        for _ in range(600)
    ]
    requests = []
    for number in range(30):
        start = D(2024, 1, 1) + dt.timedelta(days=pick.randint(-3, 30))
        end = start + dt.timedelta(days=pick.randint(-2, 12))
        requests.append((f"d{number}", pick.choice(["hot", "a", "nobody"]), start, end))
    requests += [("open", "hot", None, D(2024, 1, 3)), ("nameless", None, D(2024, 1, 1), D(2024, 1, 3))]
    expected = Counter(
        (dataset, when[:16], minutes)
        for dataset, wanted, start, end in requests
        for customer, _, minutes, when in plays
        if start and customer == wanted and start <= dt.date.fromisoformat(when[:10]) <= end
    )
    return shape(spark, plays), requests_of(spark, requests), requests, expected


def check_batch(spark, shape):
    plays, requests, wanted, expected = random_batch(spark, shape)
    extracts = extract.batch_extract(plays, requests)
    assert extracts.columns == ["dataset", *plays.columns]
    minute = F.substring(F.col("ts").cast("string"), 1, 16) if "ts" in plays.columns else F.col("ymdhm")
    rows = extracts.select("dataset", minute, F.col("minsplayed").cast("int").cast("string"))
    assert Counter(values(rows)) == expected
    per_dataset = Counter()
    for (dataset, _, _), n in expected.items():
        per_dataset[dataset] += n
    counts = extract.request_counts(plays, requests)
    assert {row["dataset"]: row["n_rows"] for row in counts.collect()} == per_dataset
    coverage = extract.batch_coverage(plays, requests)
    days = sum((end - start).days + 1 for _, _, start, end in wanted if start and end >= start)
    found = coverage.agg(F.count("*"), F.sum("n_rows")).first()
    assert tuple(found) == (days, sum(per_dataset.values()))
    return extracts


@pytest.mark.parametrize("shape", SHAPES)
def test_batch_equals_brute_force(spark, shape):
    assert "BroadcastHashJoin" in plan(check_batch(spark, shape))


@pytest.mark.parametrize("shape", SHAPES)
def test_batch_without_broadcast_equals_brute_force(spark, shape, no_broadcast):
    assert "Broadcast" not in plan(check_batch(spark, shape))


@pytest.mark.parametrize("shape", SHAPES)
def test_batch_with_few_customers_drops_the_other_plays_first(spark, shape, no_broadcast, monkeypatch):
    monkeypatch.setattr(extract, "BROADCAST_ROWS", 4)
    text = plan(check_batch(spark, shape))
    assert "LeftSemi" in text and text.index("SortMergeJoin") < text.index("BroadcastHashJoin")
    monkeypatch.setattr(extract, "BROADCAST_BYTES", 60)
    assert "Broadcast" not in plan(check_batch(spark, shape))


def test_hot_customer_is_split_in_the_shuffle_join(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        plays = spark.range(0, 60_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("customerID"),
            F.lit("x").alias("genre"),
            F.lit(1).cast("decimal(18,2)").alias("minsplayed"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 1000)").alias("ts"),
        )
        days = (D(2024, 1, 1), D(2024, 1, 2))
        requests = requests_of(spark, [("d", "hot", *days), ("e", "1", *days)])
        extracts = extract.batch_extract(plays, requests)
        assert len(extracts.collect()) == 20_001
        assert "skew=true" in plan(extracts)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_requests_with_dates_as_text(spark):
    plays = timestamped(spark, ROWS)
    rows = [
        ("a", "612", "20240109", "2024-01-10"),
        ("b", "612", "2024-01-10", "20240110"),
        ("c", "612", "soon", "20240110"),
        ("d", "612", "20240110", "20240109"),
    ]
    requests = spark.createDataFrame(rows, "dataset string, customerID string, from string, to string")
    counts = extract.request_counts(plays, requests)
    assert {row["dataset"]: row["n_rows"] for row in counts.collect()} == {"a": 2, "b": 1}
    report = {row["dataset"]: row["message"] for row in extract.extract_report(requests, counts).collect()}
    assert report["a"].startswith("Customer 612, 09/01/2024 - 10/01/2024: ")


def test_no_requests(spark):
    plays = timestamped(spark, ROWS)
    nothing = requests_of(spark, [])
    assert values(extract.batch_extract(plays, nothing)) == []
    assert values(extract.request_counts(plays, nothing)) == []


def test_report_from_written_datasets(spark, tmp_path):
    plays = timestamped(spark, ROWS)
    requests = requests_of(
        spark,
        [
            ("both1", "612", D(2024, 1, 8), D(2024, 1, 10)),
            ("both2", "612", D(2024, 1, 10), D(2024, 1, 12)),
            ("none", "612", D(2024, 3, 1), D(2024, 3, 2)),
        ],
    )
    root = write_batch(extract.batch_extract(plays, requests), str(tmp_path / "store"))
    report = extract.extract_report(requests, dataset_catalog(spark, root))
    rows = {row["dataset"]: row for row in report.collect()}
    assert [rows[name]["n_rows"] for name in ("both1", "both2", "none")] == [2, 1, 0]
    assert rows["both1"]["subject"] == "Your report is ready!"
    assert rows["both1"]["message"] == (
        "Customer 612, 08/01/2024 - 10/01/2024: the data are available under dataset ID both1."
    )
    assert rows["none"]["subject"] == "Data request: No data found"
    assert "01/03/2024 - 02/03/2024: no data were found" in rows["none"]["message"]


@pytest.fixture
def source_table(spark, tmp_path):
    day = F.col("ymd").cast("date")
    plays = text_keyed(spark, ROWS).withColumns(
        {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}
    )
    plays.write.partitionBy("year", "month", "day").option("path", str(tmp_path / "plays")).saveAsTable("source_plays")
    yield "source_plays"
    spark.sql("DROP TABLE source_plays")


def test_source_table_is_pruned_by_day(spark, source_table):
    source = play_source(spark, source_table)
    found = extract.customer_extract(source, "612", "2024-01-09", "2024-01-10")
    assert found.columns == source.columns
    assert sorted(row["minsplayed"] for row in found.collect()) == [4, 8]
    text = plan(found)
    filters = text[text.index("PartitionFilters") : text.index("PushedFilters")]
    assert "year" in filters and "month" in filters and "day" in filters
    assert "EqualTo(customerID,612)" in text
    requests = requests_of(spark, [("d", "612", D(2024, 1, 10), D(2024, 1, 11))])
    assert [row["minsplayed"] for row in extract.batch_extract(source, requests).collect()] == [8]
    coverage = extract.daily_coverage(source, "612", "2024-01-09", "2024-01-11")
    assert [n for _, n, _ in sorted(values(coverage))] == [1, 1, 0]


def test_job(spark, source_table, tmp_path):
    store = tmp_path / "store"
    request = "--customerID 612 --start 20240108 --end 2024-01-10 --dataset ann1"
    text = main(f"--source {source_table} --root {store} {request}".split())
    assert text.startswith("Your report is ready! Customer 612, 08/01/2024 - 10/01/2024")
    assert load_plays(spark, f"{store}/dataset=ann1").count() == 2
    empty = extract_dataset(play_source(spark, source_table), str(store), "ann2", "612", "2023-01-01", "2023-01-02")
    assert empty.first()["n_rows"] == 0
    assert not (store / "dataset=ann2").exists()


def _source(spark, path, rows):
    """A partitioned source; rows of customer, stored day key, year, month, day."""
    frame = spark.createDataFrame(
        [(c, "g", Decimal(1), key, y, m, d) for c, key, y, m, d in rows],
        "customerID string, genre string, minsplayed decimal(18,2), ymd string, year int, month int, day int",
    )
    frame.write.partitionBy("year", "month", "day").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def test_partitions_decide_the_day(spark, tmp_path):
    """Whatever the stored day key says, and whatever impossible partitions there are."""
    keys = [None, "20240110", "2023-05-05", "2024-01-10"]
    rows = [("1", key, 2024, 1, 10) for key in keys] + [("1", "2024-02-31", 2024, 2, 31), ("2", None, 2024, 1, 10)]
    source = _source(spark, str(tmp_path / "source"), rows)
    requests = spark.createDataFrame([("d", "1", "20240101", "20240331")], 'dataset string, customerID string, `from` string, `to` string')
    assert extract.customer_extract(source, "1", "20240110", "20240110").count() == 4
    assert extract.batch_extract(source, requests).count() == 4
    assert extract.request_counts(source, requests).first()["n_rows"] == 4
    covered = extract.batch_coverage(source, requests).where("has_data").collect()
    assert [(str(row["day"]), row["n_rows"]) for row in covered] == [("2024-01-10", 4)]
    covered = extract.daily_coverage(source, "1", "20240101", "20240331").where("has_data").collect()
    assert [(str(row["day"]), row["n_rows"]) for row in covered] == [("2024-01-10", 4)]


def test_scattered_requests_prune_partitions(spark, tmp_path):
    rows = [("1", f"2024-01-{day:02}", 2024, 1, day) for day in range(1, 31)]
    source = _source(spark, str(tmp_path / "source"), rows)
    requests = spark.createDataFrame(
        [("a", "1", "20240102", "20240102"), ("b", "1", "20240129", "20240129")],
        "dataset string, customerID string, `from` string, `to` string",
    )
    extracts = extract.batch_extract(source, requests)
    assert extracts.count() == 2
    assert "dynamicpruning" in plan(extracts)


def test_window_prunes_partitions(spark, tmp_path):
    from playlog.operators.export import raw_window

    rows = [("1", f"2024-01-{day:02}", 2024, 1, day) for day in range(1, 31)]
    source = _source(spark, str(tmp_path / "source"), rows)
    source = source.selectExpr("*", "ymd || ' 00:00' AS ymdhm")
    window = raw_window(source, "2024-01-10 22:00", "2024-01-11 04:00")
    assert window.count() == 1
    filters = next(line for line in plan(window).split("PartitionFilters")[1:])
    assert "year" in filters.split("PushedFilters")[0]
