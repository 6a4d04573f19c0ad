"""Every operator as a query over the given tables: name -> (session, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.functions.keys import with_text_keys, within_days
from playlog.functions.minutes import shown
from playlog.operators import aggregate, export, extract, validate
from playlog.plans import inputs
from playlog.plans.job import extract_batch
from playlog.schema import EXPORT_COLUMNS, PARTITION_COLUMNS, PLAYS, READ_LOG, REQUEST_LOG
from playlog.session import work_folder
from playlog.sinks import datasets, text
from playlog.sinks.store import pack, publish
from playlog.sources import store
from playlog.sources.plays import events_plays, lineitem_plays, load_groups, load_plays

Query = Callable[[SparkSession, str], DataFrame]

EVENTS = ("2024-01-01", "2024-01-30")
YEARS = ("1995-01-01", "2001-12-31")
CUSTOMER = ("149", "2024-01-08", "2024-01-21")


# --- aggregations ---------------------------------------------------------------------------------------------------


def daily_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.daily_minutes(events_plays(spark, sf_dir), *EVENTS)


def hourly_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.hourly_minutes(events_plays(spark, sf_dir), *EVENTS)


def minute_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.minute_minutes(events_plays(spark, sf_dir), *EVENTS)


def month_day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.month_day_rows(lineitem_plays(spark, sf_dir), *YEARS)


def monthly_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.monthly_minutes(lineitem_plays(spark, sf_dir), *YEARS)


def genre_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.genre_totals(events_plays(spark, sf_dir), "2024-01-05", "2024-01-20")


def genre_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.genre_order(daily_minutes(spark, sf_dir))


def ranked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.with_genre_rank(daily_minutes(spark, sf_dir))


def play_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.play_minutes(lineitem_plays(spark, sf_dir), "1998-03-01", "1998-03-31")


def play_minutes_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.play_minutes(events_plays(spark, sf_dir), "2024-01-10", "2024-01-10")


def play_minutes_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.play_minutes(lineitem_plays(spark, sf_dir), "1998-01-01", "1998-12-31")


def play_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.play_series(lineitem_plays(spark, sf_dir), "1998-01-01", "1998-12-31")


# --- tables and exports ---------------------------------------------------------------------------------------------


def display_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.display_table(daily_minutes(spark, sf_dir))


def display_table_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.display_table(play_minutes_by_hour(spark, sf_dir))


def display_table_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.display_table(monthly_minutes(spark, sf_dir))


def _page(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    return export.page(daily_minutes(spark, sf_dir), number, [F.desc_nulls_last("minsplayed"), "Date", "genre"])


def top_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, 0)


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, 1)


def raw_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = events_plays(spark, sf_dir)
    return shown(export.raw_window(plays, "2024-01-10 08:00", "2024-01-10 14:00", EXPORT_COLUMNS))


def seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the day rows, each found after the last row of the one before."""
    keys = [export.SortKey("minsplayed", descending=True), export.SortKey("Date"), export.SortKey("genre")]
    table, last = daily_minutes(spark, sf_dir), None
    for _ in range(2):
        rows = export.next_page(table, keys, last).collect()
        last = rows[-1] if rows else last
    return export.next_page(table, keys, last)


def all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table, chart and totals of a year, in one pass."""
    return aggregate.all_parts(lineitem_plays(spark, sf_dir), "1998-01-01", "1998-12-31")


def all_parts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.all_parts(events_plays(spark, sf_dir), "2024-01-10", "2024-01-10")


# --- validation -----------------------------------------------------------------------------------------------------


def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = store.dataset_listing(spark, _request_store(spark, sf_dir))
    return validate.validate_requests(inputs.form_inputs(spark, sf_dir), listing)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = store.dataset_listing(spark, _request_store(spark, sf_dir))
    return validate.accepted_reads(inputs.form_inputs(spark, sf_dir), listing)


def accepted_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).select("dataset", "timestamp", "user", "import_from", "import_to")


# --- extraction -----------------------------------------------------------------------------------------------------


def customer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, start, end = CUSTOMER
    return shown(extract.customer_extract(events_plays(spark, sf_dir, customer), customer, start, end))


def _partitioned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All plays laid out as the source table is, by year, month and day."""
    plays = datasets.stored(events_plays(spark, sf_dir))
    day = F.col("ymd").cast("date")
    parts = plays.withColumns({"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})
    path = work_folder(spark, name)
    parts.hint("rebalance", *PARTITION_COLUMNS).write.partitionBy(*PARTITION_COLUMNS).parquet(path)
    return spark.read.parquet(path)


def source_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _partitioned(spark, sf_dir, "source")
    return shown(extract.customer_extract(source, *CUSTOMER).select(PLAYS.fieldNames()))


def clustered_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer out of a source that is clustered by customers inside its days."""
    source = spark.read.parquet(datasets.write_source(events_plays(spark, sf_dir), work_folder(spark, "clustered")))
    return shown(extract.customer_extract(source, *CUSTOMER).select(PLAYS.fieldNames()))


def long_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays of requests that are years long, found by blocks of days."""
    return shown(extract.batch_extract(lineitem_plays(spark, sf_dir), inputs.long_requests(spark, sf_dir), "blocks"))


def long_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.request_counts(lineitem_plays(spark, sf_dir), inputs.long_requests(spark, sf_dir), "blocks")


def source_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays of all requests out of the partitioned source, of which only requested days are read."""
    source = _partitioned(spark, sf_dir, "batch")
    extracts = extract.batch_extract(source, inputs.late_requests(spark, sf_dir))
    return shown(extracts.select("dataset", *PLAYS.fieldNames()))


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.batch_coverage(_partitioned(spark, sf_dir, "coverage"), inputs.late_requests(spark, sf_dir))


def source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _partitioned(spark, sf_dir, "window")
    return shown(export.raw_window(source, "2024-01-10 22:00", "2024-01-11 04:00", EXPORT_COLUMNS))


def daily_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, start, end = CUSTOMER
    return extract.daily_coverage(events_plays(spark, sf_dir, customer), customer, start, end)


def batch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.batch_coverage(events_plays(spark, sf_dir), inputs.late_requests(spark, sf_dir))


def batch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(extract.batch_extract(events_plays(spark, sf_dir), inputs.requests(spark, sf_dir)))


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.request_counts(events_plays(spark, sf_dir), inputs.late_requests(spark, sf_dir))


def extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_report(inputs.late_requests(spark, sf_dir), request_counts(spark, sf_dir))


def merge_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of the partitioned source: each reads its own partition only."""
    plays = _partitioned(spark, sf_dir, "merge").select(*PLAYS.fieldNames(), *PARTITION_COLUMNS)
    days = [within_days(plays, day, day) for day in ("2024-01-08", "2024-01-09", "2024-01-10")]
    return shown(extract.merge_days(*days).select(PLAYS.fieldNames()))


# --- datasets, exports and logs, written and read back --------------------------------------------------------------


def _written_events(spark: SparkSession, sf_dir: str, name: str) -> str:
    return datasets.write_dataset(events_plays(spark, sf_dir), work_folder(spark, name), "events")


def write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(load_plays(spark, _written_events(spark, sf_dir, "write")))


def append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plays before a moment, and then all others, those without a time among them, appended to one dataset."""
    plays = events_plays(spark, sf_dir)
    root = work_folder(spark, "append")
    early = F.coalesce(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(False))
    datasets.append_dataset(plays.where(early), root, "events")
    return shown(load_plays(spark, datasets.append_dataset(plays.where(~early), root, "events")))


def double_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums of a dataset that was stored with floating minutes."""
    plays = shown(events_plays(spark, sf_dir))
    path = datasets.write_dataset(plays, work_folder(spark, "double"), "events")
    table = aggregate.daily_minutes(load_plays(spark, path), *EVENTS)
    return table.withColumn("minsplayed", F.round("minsplayed", 6))


def mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums of plays stored in three layouts: as now, whole minutes under their older name, and wide decimals."""
    groups = []
    for number, part in enumerate(_parts(spark, sf_dir)):
        rows = with_text_keys(part).drop("ts")
        if number == 1:
            rows = rows.withColumn("minsplayed", F.floor("minsplayed").cast("decimal(29,0)"))
            rows = rows.withColumnRenamed("minsplayed", "minutes_played")
        if number == 2:
            rows = rows.withColumn("minsplayed", F.col("minsplayed").cast("decimal(30,4)"))
        groups.append(work_folder(spark, f"layout-{number}"))
        rows.write.parquet(groups[-1])
    return aggregate.daily_minutes(load_groups(spark, groups), *EVENTS)


def cached_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums of a cached view that replaced an earlier one of the same name."""
    path = _written_events(spark, sf_dir, "cached")
    load_plays(spark, path, "2024-01-01", "2024-01-03", view="cached_plays", cache=True)
    load_plays(spark, path, "2024-01-05", "2024-01-20", view="cached_plays", cache=True)
    return aggregate.daily_minutes(spark.table("cached_plays"), *EVENTS)


def load_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset loaded as a view for a range of days, summed by day from its stored keys."""
    path = _written_events(spark, sf_dir, "load")
    plays = load_plays(spark, path, "2024-01-05", "2024-01-20", view="loaded_plays")
    return aggregate.daily_minutes(plays, "2024-01-01", "2024-01-10")


def loaded_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from the stored minute keys of a dataset."""
    return aggregate.hourly_minutes(load_plays(spark, _written_events(spark, sf_dir, "hours")), *EVENTS)


def compact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written_events(spark, sf_dir, "compact")
    return shown(load_plays(spark, datasets.compact_dataset(spark, path, f"{path}-compact")))


def _request_store(spark: SparkSession, sf_dir: str, requests: DataFrame | None = None) -> str:
    """The store with the dataset of every request."""
    requests = inputs.requests(spark, sf_dir) if requests is None else requests
    extracts = extract.batch_extract(events_plays(spark, sf_dir), requests)
    root = work_folder(spark, "store")
    return publish(extracts, root, "first", requests, tasks=spark.sparkContext.defaultParallelism)


def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dataset_catalog(spark, _request_store(spark, sf_dir))


def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = store.dataset_listing(spark, _request_store(spark, sf_dir))
    return listing.select("dataset", "n_files", (F.col("n_bytes") > 0).alias("has_data"))


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all requests, counted from the datasets that were written."""
    requests = inputs.late_requests(spark, sf_dir)
    written = store.dataset_catalog(spark, _request_store(spark, sf_dir, requests))
    return extract.extract_report(requests, written)


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a batch in which some requests can't be taken, with a status for each."""
    requests = inputs.typed_requests(spark, sf_dir)
    return extract_batch(events_plays(spark, sf_dir), requests, work_folder(spark, "batch-store"), "batch")


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All plays in three parts by day."""
    plays = events_plays(spark, sf_dir)
    ends = [("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-01-30")]
    return [within_days(plays, *days) for days in ends]


def _appended_store(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A store with one dataset that three commits have added to."""
    root = work_folder(spark, name)
    for number, part in enumerate(_parts(spark, sf_dir)):
        publish(part.withColumn("dataset", F.lit("all")), root, f"part-{number}", append=True)
    return root


def known_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage of all requests, from the counts that were kept with three appended commits."""
    root = _appended_store(spark, sf_dir, "coverage-store")
    return store.known_coverage(inputs.late_requests(spark, sf_dir), store.manifest(spark, root))


def packed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset of three commits, packed into one, read back for a range of days."""
    root = _appended_store(spark, sf_dir, "packed-store")
    pack(spark, root, "packed")
    return shown(store.load_dataset(spark, root, "all", "2024-01-05", "2024-01-25"))


def store_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and minutes of every dataset of the store, in one scan."""
    return store.store_minutes(spark, _request_store(spark, sf_dir))


def store_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest of a packed store and its files do not agree on: the files of the replaced commits, by commit."""
    root = _appended_store(spark, sf_dir, "drift-store")
    pack(spark, root, "packed")
    return store.drift(spark, root).groupBy("commit", "state").agg((F.count("*") > 0).alias("found"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = with_text_keys(events_plays(spark, sf_dir)).select(PLAYS.fieldNames())
    return shown(_exported(plays, "csv"))


def _exported(table: DataFrame, name: str, **options) -> DataFrame:
    """A table written as CSV and read back."""
    spark = table.sparkSession
    path = text.export_csv(table, work_folder(spark, name), **options)
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in table.schema)
    return text.read_csv(spark, path, schema)


def csv_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(hourly_minutes(spark, sf_dir), "csv-buckets", files=1, order=[F.desc("minsplayed"), "Time", "genre"])


def csv_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(genre_totals(spark, sf_dir), "csv-totals", files=1, order=["minsplayed", "genre"])


def csv_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(raw_window(spark, sf_dir), "csv-window", files=2)


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log after all requests were made twice."""
    path = work_folder(spark, "requests-log")
    for _ in range(2):
        text.append_requests(inputs.requests(spark, sf_dir), path)
    return text.read_log(spark, path, REQUEST_LOG)


def read_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read log after every user tried to load a dataset."""
    path = work_folder(spark, "reads-log")
    return text.read_log(spark, text.append_reads(_accepted(spark, sf_dir), path), READ_LOG)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        daily_minutes,
        hourly_minutes,
        minute_minutes,
        month_day_rows,
        monthly_minutes,
        genre_totals,
        genre_order,
        ranked_table,
        play_minutes,
        play_minutes_by_hour,
        play_minutes_by_month,
        play_series,
        display_table,
        display_table_hours,
        display_table_months,
        top_page,
        next_page,
        seek_page,
        all_parts,
        all_parts_by_hour,
        raw_window,
        validate_requests,
        accepted_reads,
        customer_extract,
        source_extract,
        clustered_extract,
        long_extract,
        long_counts,
        source_batch,
        source_coverage,
        source_window,
        daily_coverage,
        batch_coverage,
        batch_extract,
        request_counts,
        extract_report,
        merge_days,
        write_roundtrip,
        append_roundtrip,
        double_minutes,
        mixed_layouts,
        cached_view,
        load_range,
        loaded_hours,
        compact_roundtrip,
        dataset_catalog,
        dataset_listing,
        stored_report,
        batch_report,
        known_coverage,
        packed_store,
        store_minutes,
        store_drift,
        csv_roundtrip,
        csv_buckets,
        csv_totals,
        csv_window,
        log_append,
        read_log_append,
    )
}
