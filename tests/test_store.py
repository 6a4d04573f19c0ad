from __future__ import annotations

import math
import tempfile
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import plan, text_keyed, timestamped, values
from playlog.functions.keys import within_days
from playlog.operators import aggregate, export
from playlog.schema import PLAYS, READ_LOG, REQUEST_LOG
from playlog.session import work_folder
from playlog.sinks import datasets, text
from playlog.sources import catalog
from playlog.sources.plays import load_plays

ROWS = [
    ("612", "news", "1.50", "2024-01-08 00:00:00"),
    ("612", "film", "2.00", "2024-01-08 09:30:59"),
    ("612", None, None, "2024-01-10 23:59:59"),
]
KEYED = Counter(
    [
        ("612", "2024-01", "2024-01-08", "2024-01-08 00", "2024-01-08 00:00", "news", 1.5),
        ("612", "2024-01", "2024-01-08", "2024-01-08 09", "2024-01-08 09:30", "film", 2),
        ("612", "2024-01", "2024-01-10", "2024-01-10 23", "2024-01-10 23:59", None, None),
    ]
)


def session_with(settings):
    return SimpleNamespace(
        conf=SimpleNamespace(get=settings.get), sparkContext=SimpleNamespace(master="local[2]")
    )


def test_work_folder_is_the_shared_one():
    shared = session_with({"spark.checkpoint.dir": "hdfs://name/shared/"})
    one, other = work_folder(shared, "x"), work_folder(shared, "x")
    assert one.startswith("hdfs://name/shared/playlog-x-") and one != other
    assert work_folder(session_with({}), "x").startswith(tempfile.gettempdir())


def test_dataset_reads_back_as_written(spark, tmp_path):
    plays = timestamped(spark, ROWS)
    path = datasets.write_dataset(plays, str(tmp_path), "ann1")
    assert sorted(p.name for p in (tmp_path / "dataset=ann1").glob("ymd=*")) == ["ymd=2024-01-08", "ymd=2024-01-10"]
    loaded = load_plays(spark, path)
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in PLAYS]
    assert Counter(values(loaded)) == KEYED
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        datasets.write_dataset(plays, str(tmp_path), "ann1")
    datasets.append_dataset(plays.limit(1), str(tmp_path), "ann1", rebalance=False)
    assert load_plays(spark, path).count() == 4


def test_days_prune_the_folders_of_a_dataset(spark, tmp_path):
    path = datasets.write_dataset(timestamped(spark, ROWS), str(tmp_path), "ann1")
    loaded = load_plays(spark, path, "2024-01-09", "2024-01-11")
    assert [row["ymd"] for row in loaded.collect()] == ["2024-01-10"]
    table = aggregate.daily_minutes(load_plays(spark, path), "2024-01-08", "2024-01-09")
    for frame in (loaded, table, export.raw_window(load_plays(spark, path), "2024-01-08 09:00", "2024-01-08 10:00")):
        partition_filters = plan(frame).split("PartitionFilters: [")[1].split("]")[0]
        assert "ymd" in partition_filters
    assert "struct<genre:string,minsplayed:decimal(18,2)>" in plan(table)


def test_compaction_keeps_rows(spark, tmp_path):
    path = datasets.write_dataset(timestamped(spark, ROWS), str(tmp_path), "ann1")
    one = datasets.compact_dataset(spark, path, str(tmp_path / "one"), files=1)
    by_size = datasets.compact_dataset(spark, path, str(tmp_path / "size"))
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    for target in (one, by_size):
        assert Counter(values(load_plays(spark, target))) == KEYED
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        datasets.compact_dataset(spark, path, one)


def test_hot_dataset_gets_many_files_and_small_ones_few(spark, tmp_path):
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        plays = spark.range(0, 40_000, 1, 16).select(
            F.when(F.col("id") % 100 == 0, (F.col("id") % 10_000).cast("string")).otherwise("hot").alias("dataset"),
            F.col("id").cast("string").alias("customerID"),
            F.lit("x").alias("genre"),
            F.lit(1).cast("decimal(18,2)").alias("minsplayed"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7919 % 100000)").alias("ts"),
        )
        datasets.write_batch(plays, str(tmp_path / "store"))
    finally:
        for name in settings:
            spark.conf.unset(name)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "store").glob("dataset=*")}
    assert files.pop("dataset=hot") > 2
    # All but those that hash to the partition of the hot one.
    assert len(files) == 100 and sum(n == 1 for n in files.values()) > 60
    assert catalog.dataset_catalog(spark, str(tmp_path / "store")).agg(F.sum("n_rows")).first()[0] == 40_000


def test_source_without_text_keys_is_written_by_day(spark, tmp_path):
    wide = spark.sql("select '612' customerID, 9L starttimesecond, 2024 year, 1 month, 8 day")
    path = datasets.write_dataset(wide, str(tmp_path), "wide")
    assert [p.name for p in (tmp_path / "dataset=wide").glob("ymd=*")] == ["ymd=2024-01-08"]
    datasets.write_batch(wide.withColumn("dataset", F.lit("w")), str(tmp_path / "batch"))
    compact = datasets.compact_dataset(spark, path, str(tmp_path / "compact"))
    assert spark.read.parquet(compact).select("ymd", "starttimesecond").first() == ("2024-01-08", 9)


def test_records_per_file(spark, tmp_path):
    plays = timestamped(spark, ROWS[:1] * 10)
    datasets.write_dataset(plays, str(tmp_path), "ann1", max_records=4)
    assert len(list(tmp_path.glob("dataset=ann1/ymd=*/*.parquet"))) == 3


def test_catalog_of_all_layouts(spark, tmp_path):
    root = tmp_path / "a store+more"
    plays = timestamped(spark, ROWS)
    datasets.write_dataset(plays, str(root), "by_day")
    datasets.write_batch(plays.withColumn("dataset", F.lit("odd: 50%+x")), str(root), mode="append")
    text_keyed(spark, ROWS[:2]).write.parquet(str(root / "flat"))
    (root / "empty").mkdir()
    text_keyed(spark, ROWS[:2]).coalesce(1).write.mode("append").parquet(str(root))
    expected = {
        ("by_day", "612", 3, 2, "2024-01-08", "2024-01-10"),
        ("flat", "612", 2, 1, "2024-01-08", "2024-01-08"),
        ("odd: 50%+x", "612", 3, 2, "2024-01-08", "2024-01-10"),
    }
    for name in (str(root), f"{root}/", f"file:{root}", f"file://{root}"):
        assert set(values(catalog.dataset_catalog(spark, name))) == expected
        listing = {row["dataset"]: row for row in catalog.dataset_listing(spark, name).collect()}
        assert set(listing) == {"by_day", "flat", "odd: 50%+x", "empty"}
        assert listing["by_day"]["n_files"] == 2 and listing["flat"]["n_bytes"] > 0
    counted = plan(catalog.dataset_catalog(spark, str(root))).splitlines()
    nearest_to_scan = [line for line in counted if "Aggregate" in line][-1]
    assert "HashAggregate" in nearest_to_scan and "regexp" not in counted[-1]
    listed = plan(catalog.dataset_listing(spark, str(root)))
    assert "ReadSchema: struct<path:string,length:bigint>" in listed


def test_dataset_names_are_escaped_alike(spark, tmp_path):
    plays = timestamped(spark, ROWS)
    for name in ("odd: 50%+x", "a/b=c", "ann.b-c_d@e"):
        batch, single = str(tmp_path / "batch"), str(tmp_path / "single")
        datasets.write_batch(plays.withColumn("dataset", F.lit(name)), batch, mode="append")
        path = datasets.write_dataset(plays, single, name)
        assert load_plays(spark, path).count() == 3
        assert load_plays(spark, catalog.dataset_path(batch, name)).count() == 3
        for root in (batch, single):
            assert name in {row["dataset"] for row in catalog.dataset_catalog(spark, root).collect()}


def test_load_checks_the_schema(spark, tmp_path):
    text_keyed(spark, ROWS).drop("ymdh").write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="columns missing: ymdh"):
        load_plays(spark, str(tmp_path / "short"))
    text_keyed(spark, ROWS).withColumn("minsplayed", F.lit("x")).write.parquet(str(tmp_path / "text"))
    with pytest.raises(ValueError, match="minsplayed is string"):
        load_plays(spark, str(tmp_path / "text"))
    floats = text_keyed(spark, ROWS).withColumn("minsplayed", F.expr("if(genre = 'news', double('NaN'), 2.499)"))
    floats.write.parquet(str(tmp_path / "floats"))
    found = {row["genre"]: row["minsplayed"] for row in load_plays(spark, str(tmp_path / "floats")).collect()}
    assert math.isnan(found["news"]) and found["film"] == 2.499
    whole = F.col("minsplayed").cast("decimal(29,0)")
    wide = text_keyed(spark, ROWS).withColumns({"minsplayed": whole, "more": F.lit(1)})
    wide.write.parquet(str(tmp_path / "wide"))
    assert load_plays(spark, str(tmp_path / "wide")).dtypes[-1] == ("minsplayed", "decimal(29,0)")


def test_view_is_cached_and_replaced(spark, tmp_path):
    first = datasets.write_dataset(timestamped(spark, ROWS), str(tmp_path), "a")
    second = datasets.write_dataset(timestamped(spark, ROWS[:1]), str(tmp_path), "b")
    assert load_plays(spark, first, view="df", cache=True).count() == 3
    assert spark.catalog.isCached("df")
    assert load_plays(spark, second, view="df").count() == 1
    assert not spark.catalog.isCached("df")
    assert spark.table("df").count() == 1
    with pytest.raises(ValueError, match="view"):
        load_plays(spark, first, cache=True)
    spark.catalog.dropTempView("df")


def test_csv_format(spark, tmp_path):
    table = aggregate.hourly_minutes(timestamped(spark, ROWS[:1]), "2024-01-08", "2024-01-08")
    odd = table.unionByName(
        spark.sql("select timestamp_ntz'2024-01-08 10:00:00' Time, ' a;\"b\" ' genre, double(null) minsplayed")
    )
    path = text.export_csv(odd.orderBy("Time"), str(tmp_path / "csv"), files=1)
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_text().splitlines() == [
        "Time;genre;minsplayed",
        "2024-01-08T00:00:00Z;news;1.5",
        '2024-01-08T10:00:00Z;" a;""b"" ";NA',
    ]
    back = text.read_csv(spark, path, "Time timestamp_ntz, genre string, minsplayed double")
    assert Counter(values(back)) == Counter(values(odd))


def test_csv_with_line_breaks(spark, tmp_path):
    table = spark.sql("select 'a\nb' genre, 1.5D minsplayed union all select '', null")
    path = text.export_csv(table, str(tmp_path / "csv"))
    back = text.read_csv(spark, path, "genre string, minsplayed double", multi_line=True)
    assert Counter(values(back)) == Counter(values(table))


def test_logs(spark, tmp_path):
    path = str(tmp_path / "requests")
    request = spark.sql(
        "select timestamp_ntz'2024-01-08 10:00:00.123' timestamp, 'ann' user, 'ann@example.com' email, "
        "'0612' customerID, date'2024-01-01' `from`, date'2024-01-02' `to`"
    )
    for _ in range(2):
        text.append_requests(request, path)
    parts = list((tmp_path / "requests").glob("*.csv"))
    assert len(parts) == 2
    assert parts[0].read_text().splitlines() == [
        "timestamp;user;email;customerID;from;to",
        "2024-01-08 10:00:00;ann;ann@example.com;0612;2024-01-01;2024-01-02",
    ]
    assert values(text.read_log(spark, path, REQUEST_LOG)) == [
        ("2024-01-08 10:00:00", "ann", "ann@example.com", "0612", "2024-01-01", "2024-01-02")
    ] * 2
    reads = request.selectExpr("timestamp", "user", "'ann1' dataset", "`from` import_from", "`to` import_to")
    text.append_reads(reads, str(tmp_path / "reads"))
    assert values(text.read_log(spark, str(tmp_path / "reads"), READ_LOG)) == [
        ("2024-01-08 10:00:00", "ann", "ann1", "2024-01-01", "2024-01-02")
    ]


def test_null_day_is_kept_but_drops_out_of_ranges(spark, tmp_path):
    plays = text_keyed(spark, ROWS[:1]).withColumn("ymd", F.lit(None).cast("string"))
    path = datasets.write_dataset(plays, str(tmp_path), "odd")
    loaded = load_plays(spark, path)
    assert values(loaded)[0][2] is None
    assert within_days(loaded, "0001-01-01", "9999-12-31").count() == 0
    assert export.raw_window(loaded, "2024-01-08 00:00", "2024-01-08 00:00").count() == 1
