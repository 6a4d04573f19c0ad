from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import SHAPES, text_keyed, timestamped, values
from playlog.functions.minutes import sum_minutes
from playlog.operators import aggregate
from playlog.schema import PLAYS

ROWS = [
    ("612", "news", "10.50", "2024-01-10 08:05:10"),
    ("612", "news", "4.25", "2024-01-10 08:05:59"),
    ("612", "film", "14.75", "2024-01-10 08:59:00"),
    ("612", "film", "1.00", "2024-01-10 09:00:00"),
    ("612", None, "2.00", "2024-01-11 00:00:00"),
    ("612", "kids", None, "2024-01-11 23:59:59"),
    ("612", "film", "7.00", "2024-02-01 00:00:00"),
]
D = dt.date


@pytest.mark.parametrize("shape", SHAPES)
def test_hours(spark, shape):
    table = aggregate.hourly_minutes(shape(spark, ROWS), "2024-01-10", "2024-01-11")
    assert table.columns == ["Time", "genre", "minsplayed"]
    assert values(table) == [
        (dt.datetime(2024, 1, 10, 8), "film", 14.75),  # ties: bucket, then genre
        (dt.datetime(2024, 1, 10, 8), "news", 14.75),
        (dt.datetime(2024, 1, 11, 0), None, 2.0),
        (dt.datetime(2024, 1, 10, 9), "film", 1.0),
        (dt.datetime(2024, 1, 11, 23), "kids", 0.0),
    ]


@pytest.mark.parametrize("shape", SHAPES)
def test_minutes_are_in_order_of_time_and_keep_null(spark, shape):
    table = aggregate.minute_minutes(shape(spark, ROWS), "20240110", "20240111")
    assert values(table) == [
        ("2024-01-10 08:05", "news", 14.75),
        ("2024-01-10 08:59", "film", 14.75),
        ("2024-01-10 09:00", "film", 1.0),
        ("2024-01-11 00:00", None, 2.0),
        ("2024-01-11 23:59", "kids", None),
    ]


@pytest.mark.parametrize("shape", SHAPES)
def test_days_and_months(spark, shape):
    plays = shape(spark, ROWS)
    days = aggregate.daily_minutes(plays, "2024-01-10", "2024-02-01")
    assert values(days) == [
        (D(2024, 1, 10), "film", 15.75),
        (D(2024, 1, 10), "news", 14.75),
        (D(2024, 2, 1), "film", 7.0),
        (D(2024, 1, 11), None, 2.0),
        (D(2024, 1, 11), "kids", 0.0),
    ]
    rows = aggregate.month_day_rows(plays, "2024-01-10", "2024-02-01")
    assert values(rows)[-1] == (D(2024, 1, 1), "kids", None)
    assert len(values(rows)) == 5
    months = aggregate.monthly_minutes(plays, "2024-01-10", "2024-02-01")
    assert values(months) == [
        (D(2024, 1, 1), "film", 15.75),
        (D(2024, 1, 1), "news", 14.75),
        (D(2024, 2, 1), "film", 7.0),
        (D(2024, 1, 1), None, 2.0),
        (D(2024, 1, 1), "kids", 0.0),
    ]


def test_range_ends_are_inclusive(spark):
    ends = ("00:00:00", "23:59:59.999999")
    plays = timestamped(spark, [("1", "a", "1", f"2024-01-0{day} {time}") for day in (1, 2, 3) for time in ends])
    assert values(aggregate.daily_minutes(plays, "2024-01-02", "2024-01-02")) == [(D(2024, 1, 2), "a", 2.0)]
    assert len(values(aggregate.daily_minutes(plays, "2024-01-01", "2024-01-03"))) == 3


@pytest.mark.parametrize(
    "end, grain, bucket",
    [
        ("2024-01-01", "hour", "Time"),
        ("2024-01-02", "day", "Date"),
        ("2024-01-31", "day", "Date"),
        ("2024-02-01", "month", "Month"),
    ],
)
def test_grain_follows_the_length_of_the_range(spark, end, grain, bucket):
    assert aggregate.grain("2024-01-01", end) == grain
    for shape in SHAPES:
        plays = shape(spark, ROWS)
        assert aggregate.play_minutes(plays, "2024-01-01", end).columns == [bucket, "genre", "minsplayed"]
        assert aggregate.play_series(plays, "2024-01-01", end).columns == [bucket, "genre", "minsplayed"]


def test_month_table_keeps_days_and_series_sums_them(spark):
    minutes = {"2023-12-30": "1", "2023-12-31": "2", "2024-01-01": "4"}
    plays = timestamped(spark, [("1", "a", played, f"{day} 10:00:00") for day, played in minutes.items()])
    december, january = D(2023, 12, 1), D(2024, 1, 1)
    both = ("2023-12-01", "2024-01-31")
    assert values(aggregate.play_minutes(plays, *both)) == [
        (january, "a", 4.0),
        (december, "a", 2.0),
        (december, "a", 1.0),
    ]
    assert values(aggregate.play_series(plays, *both)) == [(january, "a", 4.0), (december, "a", 3.0)]


def test_reversed_range_is_refused(spark):
    with pytest.raises(ValueError, match="end date must be the same as or after"):
        aggregate.play_minutes(timestamped(spark, ROWS), "2024-01-02", "2024-01-01")


def test_broken_keys(spark):
    plays = text_keyed(spark, ROWS[:1]).unionByName(
        spark.createDataFrame(
            [
                ("612", "2024-01", None, None, "2024-01-10 08:00", "lost", Decimal(1)),
                ("612", "2024-01", "2024-01-10", None, "xx", "odd", Decimal(2)),
                ("612", "2024-01", "2024-01-10", None, "2024-01-10", "odd", Decimal(3)),
                ("612", "2024-01", "2024-01-10", None, "2024-01-10 25:00", "odd", Decimal(4)),
            ],
            PLAYS,
        )
    )
    assert values(aggregate.hourly_minutes(plays, "2024-01-10", "2024-01-10")) == [
        (dt.datetime(2024, 1, 10, 8), "news", 10.5),
        (None, "odd", 9.0),
    ]


def test_genre_order_is_first_appearance(spark):
    rows = [
        ("1", "b", "5", "2024-01-02 00:00:00"),
        ("1", "a", "5", "2024-01-03 00:00:00"),
        ("1", "c", "5", "2024-01-02 00:00:00"),
        ("1", "d", "9", "2024-01-05 00:00:00"),
        ("1", "b", "1", "2024-01-06 00:00:00"),
        ("1", None, "7", "2024-01-06 00:00:00"),
        ("1", "z", None, "2024-01-06 00:00:00"),
    ]
    for shape in SHAPES:
        for table in (
            aggregate.daily_minutes(shape(spark, rows), "2024-01-01", "2024-01-10"),
            aggregate.month_day_rows(shape(spark, rows), "2024-01-01", "2024-01-10"),
        ):
            shown = list(dict.fromkeys(row["genre"] for row in table.collect()))
            ranks = {row["genre"]: row["genre_rank"] for row in aggregate.genre_order(table).collect()}
            assert [ranks[genre] for genre in shown] == list(range(1, len(shown) + 1))
            ranked = aggregate.with_genre_rank(table)
            assert [row["genre_rank"] for row in ranked.collect()] == [ranks[row["genre"]] for row in table.collect()]


def test_genre_totals_go_up_and_ties_follow_the_genre_order(spark):
    rows = [
        ("1", "y", "3", "2024-01-02 00:00:00"),
        ("1", "y", "3", "2024-01-03 00:00:00"),
        ("1", "x", "1", "2024-01-02 00:00:00"),
        ("1", "x", "5", "2024-01-03 00:00:00"),
        ("1", "b", "2", "2024-01-03 00:00:00"),
        ("1", "n", None, "2024-01-03 00:00:00"),
    ]
    expected = [("n", 0.0), ("b", 2.0), ("x", 6.0), ("y", 6.0)]
    for shape in SHAPES:
        assert values(aggregate.genre_totals(shape(spark, rows), "2024-01-01", "2024-01-10")) == expected


def test_grains_agree(spark):
    first = dt.datetime(2024, 1, 1)
    rows = [
        (str(i % 3), "abc"[i % 3], f"{i}.{i % 100:02d}", str(first + dt.timedelta(minutes=37 * i))) for i in range(900)
    ]
    plays = timestamped(spark, rows)
    ends = ("2024-01-02", "2024-01-20")

    def total(table):
        sums = table.groupBy("genre").agg(F.sum("minsplayed").alias("sum"))
        return {row["genre"]: round(row["sum"], 2) for row in sums.collect()}

    made = [
        f(plays, *ends)
        for f in (
            aggregate.minute_minutes,
            aggregate.hourly_minutes,
            aggregate.daily_minutes,
            aggregate.monthly_minutes,
            aggregate.month_day_rows,
            aggregate.genre_totals,
        )
    ]
    assert all(total(table) == total(made[0]) for table in made)


@pytest.mark.parametrize(
    "kind, big",
    [
        ("decimal(29,0)", "12345678901234567890"),
        ("decimal(18,2)", "1234567890123.45"),
        ("decimal(38,10)", "99999999.0000000001"),
        ("decimal(5,2)", "999.99"),
        ("int", "2000000"),
        ("double", "0.5"),
    ],
)
def test_sums_of_all_widths(spark, kind, big):
    rows = [("a", big), ("a", "1"), ("a", None), ("a", "-" + big), ("a", big), ("b", None), ("c", "2")]
    plays = spark.createDataFrame(rows, "genre string, minutes string").select(
        "genre", F.col("minutes").cast(kind).alias("minsplayed")
    )
    for zero in (False, True):
        sums = sum_minutes(plays, {"genre": F.col("genre")}, zero)
        got = {row["genre"]: row["minsplayed"] for row in sums.collect()}
        assert Decimal(str(got["a"])) == Decimal(big) + 1
        assert got["b"] == (0 if zero else None) and got["c"] == 2


def test_session_time_zone_does_not_matter(spark):
    rows = [("1", "a", "1", "2024-03-31 02:30:00")]
    day = ("2024-03-31", "2024-03-31")
    # There is no half past two on that day in Berlin.
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for shape in SHAPES:
            frame = shape(spark, rows)
            assert values(aggregate.hourly_minutes(frame, *day)) == [(dt.datetime(2024, 3, 31, 2), "a", 1.0)]
            assert values(aggregate.minute_minutes(frame, *day)) == [("2024-03-31 02:30", "a", 1.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", [1, 2])
def test_aggregates_equal_brute_force(spark, shape, seed):
    pick = random.Random(seed)
    rows = [
        (
            "612",
            # One genre holds a third of the plays.
            pick.choice(["hot", "hot", "a", "b", None, "c"]),
            pick.choice([None, "0.00", "0.10", "1234567.89", f"{pick.randint(0, 500)}.{pick.randint(10, 99)}"]),
            str(dt.datetime(2023, 12, 20) + dt.timedelta(seconds=pick.randint(0, 50 * 86_400))),
        )
        for _ in range(400)
    ]
    plays = shape(spark, rows)
    start, end = "2023-12-25", "2024-01-31"
    kept = [(g, m and Decimal(m), dt.datetime.fromisoformat(t)) for _, g, m, t in rows if start <= t[:10] <= end]

    def expected(bucket, zero=True):
        sums = {}
        for genre, minutes, when in kept:
            key = (bucket(when), genre)
            if minutes is None:
                sums.setdefault(key, None)
            else:
                sums[key] = (sums.get(key) or 0) + minutes
        return {key: (0.0 if zero else None) if value is None else float(value) for key, value in sums.items()}

    def found(table):
        lines = [tuple(row) for row in table.collect()]
        result = {(bucket, genre): minutes for bucket, genre, minutes in lines}
        assert len(result) == len(lines)
        return result

    hour = lambda when: when.replace(minute=0, second=0)
    assert found(aggregate.minute_minutes(plays, start, end)) == expected(lambda when: str(when)[:16], zero=False)
    assert found(aggregate.hourly_minutes(plays, start, end)) == expected(hour)
    assert found(aggregate.daily_minutes(plays, start, end)) == expected(dt.datetime.date)
    assert found(aggregate.monthly_minutes(plays, start, end)) == expected(lambda when: when.date().replace(day=1))
    days = expected(dt.datetime.date, zero=False)
    table = aggregate.month_day_rows(plays, start, end)
    assert Counter(values(table)) == Counter((day.replace(day=1), genre, m) for (day, genre), m in days.items())
    totals = {genre: minutes for (_, genre), minutes in expected(lambda when: 0).items()}
    lines = values(aggregate.genre_totals(plays, start, end))
    assert dict(lines) == totals and [m for _, m in lines] == sorted(totals.values())
