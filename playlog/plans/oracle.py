"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from playlog import messages


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


EVENT_PLAYS = """
SELECT CAST(user_id AS VARCHAR) AS "customerID", event_type AS genre,
       CAST(value AS DECIMAL(18,2)) AS minsplayed, ts
FROM events"""

LINEITEM_PLAYS = """
SELECT CAST(l_suppkey AS VARCHAR) AS "customerID", l_returnflag AS genre,
       CAST(l_quantity AS DECIMAL(18,2)) AS minsplayed, l_shipdate AS ts
FROM lineitem"""


def _sums(plays: str, bucket: str, name: str, start: str, end: str, zero: bool = True) -> str:
    minutes = "CAST(sum(minsplayed) AS DOUBLE)"
    if zero:
        minutes = f"coalesce({minutes}, 0)"
    return f"""
SELECT {bucket} AS "{name}", genre, {minutes} AS minsplayed
FROM ({plays}) plays
WHERE CAST(ts AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'
GROUP BY 1, 2"""


_DAY = "CAST(ts AS DATE)"
_HOUR = "date_trunc('hour', ts)"
_MONTH = "CAST(date_trunc('month', ts) AS DATE)"
_MONTH_LENGTH = ("2024-01-01", "2024-01-30")
_YEARS = ("1995-01-01", "2001-12-31")
_YEAR = ("1998-01-01", "1998-12-31")

DAILY = _sums(EVENT_PLAYS, _DAY, "Date", *_MONTH_LENGTH)
HOURLY = _sums(EVENT_PLAYS, _HOUR, "Time", *_MONTH_LENGTH)
HOURS_OF_DAY = _sums(EVENT_PLAYS, _HOUR, "Time", "2024-01-10", "2024-01-10")
MONTHLY = _sums(LINEITEM_PLAYS, _MONTH, "Month", *_YEARS)


def _month_rows(start: str, end: str) -> str:
    days = _sums(LINEITEM_PLAYS, _DAY, "Date", start, end, zero=False)
    return f"""
SELECT CAST(date_trunc('month', "Date") AS DATE) AS "Month", genre, minsplayed FROM ({days}) days"""


KEYED_EVENTS = f"""
SELECT "customerID", strftime(ts, '%Y-%m') AS ym, strftime(ts, '%Y-%m-%d') AS ymd,
       strftime(ts, '%Y-%m-%d %H') AS ymdh, strftime(ts, '%Y-%m-%d %H:%M') AS ymdhm,
       genre, CAST(minsplayed AS DOUBLE) AS minsplayed, ts
FROM ({EVENT_PLAYS}) plays"""

KEYED_ROWS = f'SELECT "customerID", ym, ymd, ymdh, ymdhm, genre, minsplayed FROM ({KEYED_EVENTS}) keyed'

REQUESTS = """
SELECT 'user' || user_id || strftime(min(ts), '%Y%m%d%H%M%S') AS dataset, min(ts) AS made,
       'user' || user_id AS "user", 'user' || user_id || '@example.com' AS email, user_id,
       CAST(user_id AS VARCHAR) AS "customerID",
       CAST(min(ts) AS DATE) AS "from", CAST(min(ts) AS DATE) + CAST(user_id % 20 AS INTEGER) AS "to"
FROM events GROUP BY user_id"""

LATE_REQUESTS = f"""
SELECT dataset, "customerID",
       CASE WHEN user_id % 7 = 0 THEN "from" + 400 ELSE "from" END AS "from",
       CASE WHEN user_id % 7 = 0 THEN "to" + 400 ELSE "to" END AS "to"
FROM ({REQUESTS}) requests"""

INPUTS = f"""
SELECT CASE WHEN user_id % 3 = 0 THEN dataset || 'x' WHEN user_id % 11 = 0 THEN '' ELSE dataset END AS dataset,
       made AS "timestamp", "user",
       "from" AS import_from, "from" + CAST(user_id % 5 - 1 AS INTEGER) AS import_to,
       "from" AS view_from, "from" + CAST(user_id % 7 - 1 AS INTEGER) AS view_to,
       "from" AS raw_from, "from" + CASE WHEN user_id % 13 = 0 THEN 1 ELSE 0 END AS raw_to,
       CASE user_id % 4 WHEN 0 THEN '8:05' WHEN 1 THEN '08:00' WHEN 2 THEN 'xx' ELSE '22:15' END AS raw_start,
       CASE user_id % 6 WHEN 0 THEN '14:00' WHEN 1 THEN '14:01' WHEN 2 THEN NULL WHEN 3 THEN '25:00'
                        WHEN 4 THEN '9:30' ELSE '23:59' END AS raw_end
FROM ({REQUESTS}) requests"""

ACCEPTED = f"""
SELECT dataset, "timestamp", "user", import_from, import_to FROM ({INPUTS}) inputs
WHERE import_from <= import_to AND dataset IN (SELECT dataset FROM ({REQUESTS}) requests)"""


def _parsed(day: str, time: str) -> str:
    return f"try_strptime(CAST({day} AS VARCHAR) || ' ' || {time}, '%Y-%m-%d %H:%M')"


VALIDATED = f"""
WITH inputs AS (
  SELECT *, {_parsed('raw_from', 'raw_start')} AS start_at, {_parsed('raw_to', 'raw_end')} AS end_at,
         dataset IN (SELECT dataset FROM ({REQUESTS}) requests) AS known
  FROM ({INPUTS}) typed),
checked AS (
  SELECT *,
    CASE WHEN dataset <> '' AND NOT known THEN {_text(messages.NOT_FOUND)} END AS dataset_error,
    CASE WHEN import_to < import_from THEN {_text(messages.DATES_REVERSED)} END AS import_error,
    CASE WHEN view_to < view_from THEN {_text(messages.DATES_REVERSED)} END AS view_error,
    CASE WHEN end_at - start_at > INTERVAL 6 HOUR THEN {_text(messages.RANGE_TOO_LONG)} END AS range_error,
    CASE WHEN start_at IS NULL THEN {_text(messages.START_INVALID)} END AS start_error,
    CASE WHEN end_at IS NULL THEN {_text(messages.END_INVALID)} END AS end_error
  FROM inputs)
SELECT * EXCLUDE (start_at, end_at, known),
  coalesce(dataset_error, import_error, view_error, range_error, start_error, end_error) IS NULL AS valid
FROM checked"""


def _request_sums(requests: str, plays: str = EVENT_PLAYS) -> str:
    return f"""
SELECT dataset, count(*) AS n_rows, CAST(sum(minsplayed) AS DOUBLE) AS minsplayed
FROM ({requests}) requests JOIN ({plays}) plays
  ON plays."customerID" = requests."customerID" AND CAST(ts AS DATE) BETWEEN "from" AND "to"
GROUP BY dataset"""


REPORT = f"""
WITH requests AS ({LATE_REQUESTS}), counts AS ({_request_sums('SELECT * FROM requests')}),
joined AS (
  SELECT requests.*, coalesce(n_rows, 0) AS n_rows FROM requests LEFT JOIN counts USING (dataset))
SELECT dataset, "customerID", n_rows,
  CASE WHEN n_rows > 0 THEN {_text(messages.REPORT_READY)} ELSE {_text(messages.REPORT_EMPTY)} END AS subject,
  'Customer ' || "customerID" || ', ' || strftime("from", '%d/%m/%Y') || ' - ' || strftime("to", '%d/%m/%Y') || ': ' ||
  CASE WHEN n_rows > 0 THEN replace({_text(messages.REPORT_FOUND)}, '%s', dataset)
       ELSE {_text(messages.REPORT_NONE)} END AS message
FROM joined"""


TYPED_REQUESTS = f"""
SELECT CASE WHEN user_id % 17 = 0 THEN '' WHEN user_id % 19 = 0 THEN 'same' ELSE dataset END AS dataset, "customerID",
       CASE WHEN user_id % 13 <> 0 THEN "from" END AS "from",
       CASE WHEN user_id % 11 = 0 THEN "from" - 1 ELSE "to" END AS "to"
FROM (SELECT *, CAST("customerID" AS BIGINT) AS user_id FROM ({LATE_REQUESTS}) late) requests"""

BATCH_REPORT = f"""
WITH requests AS ({TYPED_REQUESTS}), counts AS ({_request_sums('SELECT * FROM requests')}),
checked AS (
  SELECT requests.*, coalesce(n_rows, 0) AS found,
    CASE WHEN dataset = '' THEN {_text(messages.NO_DATASET)}
         WHEN "from" IS NULL THEN {_text(messages.DATES_INVALID)}
         WHEN "to" < "from" THEN {_text(messages.DATES_REVERSED)}
         WHEN count(*) OVER (PARTITION BY dataset) > 1 THEN {_text(messages.DATASET_REPEATED)} END AS error
  FROM requests LEFT JOIN counts USING (dataset))
SELECT dataset, "customerID", CASE WHEN error IS NULL THEN found ELSE 0 END AS n_rows,
  CASE WHEN error IS NOT NULL THEN 'rejected' WHEN found > 0 THEN 'ready' ELSE 'empty' END AS status,
  CASE WHEN error IS NOT NULL THEN {_text(messages.REQUEST_REJECTED)}
       WHEN found > 0 THEN {_text(messages.REPORT_READY)} ELSE {_text(messages.REPORT_EMPTY)} END AS subject,
  coalesce(error,
    'Customer ' || "customerID" || ', ' || strftime("from", '%d/%m/%Y') || ' - ' || strftime("to", '%d/%m/%Y') || ': ' ||
    CASE WHEN found > 0 THEN replace({_text(messages.REPORT_FOUND)}, '%s', dataset)
         ELSE {_text(messages.REPORT_NONE)} END) AS message
FROM checked"""


def _request_rows(requests: str, plays: str) -> str:
    return f"""
SELECT dataset, plays.* FROM ({requests}) requests JOIN ({plays}) plays
  ON plays."customerID" = requests."customerID" AND CAST(ts AS DATE) BETWEEN "from" AND "to" """


CATALOG = f"""
SELECT dataset, min("customerID") AS "customerID", count(*) AS n_rows,
       count(DISTINCT CAST(ts AS DATE)) AS n_days,
       strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
FROM ({_request_rows(REQUESTS, EVENT_PLAYS)}) extracts GROUP BY dataset"""

COVERAGE = f"""
WITH days AS (
  SELECT dataset, "customerID", CAST(unnest(generate_series("from", "to", INTERVAL 1 DAY)) AS DATE) AS day
  FROM ({LATE_REQUESTS}) requests),
counts AS (
  SELECT "customerID", CAST(ts AS DATE) AS day, count(*) AS n FROM ({EVENT_PLAYS}) plays GROUP BY 1, 2)
SELECT dataset, "customerID", day, coalesce(n, 0) AS n_rows, coalesce(n, 0) > 0 AS has_data
FROM days LEFT JOIN counts USING ("customerID", day)"""

TOTALS = f"""
SELECT genre, coalesce(CAST(sum(minsplayed) AS DOUBLE), 0) AS minsplayed
FROM ({EVENT_PLAYS}) plays
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
GROUP BY genre"""

WINDOW = f"""
SELECT "customerID", genre, minsplayed, ym, ymd, ymdh, ymdhm FROM ({KEYED_EVENTS}) keyed
WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-10 08:00:00' AND TIMESTAMP '2024-01-10 14:00:00'"""

GENRE_ORDER = f"""
WITH days AS ({DAILY}),
shown AS (SELECT genre, row_number() OVER (ORDER BY minsplayed DESC NULLS LAST, "Date", genre) AS line FROM days),
firsts AS (SELECT genre, min(line) AS line FROM shown GROUP BY genre)
SELECT genre, CAST(row_number() OVER (ORDER BY line) AS INTEGER) AS genre_rank FROM firsts"""

EVENT_ROWS = f'SELECT "customerID", genre, CAST(minsplayed AS DOUBLE) AS minsplayed, ts FROM ({EVENT_PLAYS}) plays'

REQUEST_LOG_ROWS = f"""
SELECT strftime(made, '%Y-%m-%d %H:%M:%S') AS "timestamp", "user", email, "customerID",
       CAST("from" AS VARCHAR) AS "from", CAST("to" AS VARCHAR) AS "to"
FROM ({REQUESTS}) requests"""

LONG_REQUESTS = """
SELECT 'supplier' || l_suppkey AS dataset, CAST(l_suppkey AS VARCHAR) AS "customerID", CAST(min(l_shipdate) AS DATE) AS "from",
       CAST(min(l_shipdate) AS DATE) + CAST(l_suppkey * 37 % 2500 AS INTEGER) AS "to"
FROM lineitem GROUP BY l_suppkey"""


def _parts(table: str, series: str | None, plays: str, start: str, end: str) -> str:
    """Table, chart and totals of a range, a query for each."""
    bucket = next(name for name in ('"Time"', '"Date"') if name in table)
    chart = f"""
UNION ALL SELECT 'series', CAST("Month" AS TIMESTAMP), genre, minsplayed FROM ({series}) series""" if series else ""
    return f"""
SELECT 'table' AS part, CAST({bucket} AS TIMESTAMP) AS bucket, genre, minsplayed FROM ({table}) days{chart}
UNION ALL
SELECT 'totals', CAST(NULL AS TIMESTAMP), genre, coalesce(CAST(sum(minsplayed) AS DOUBLE), 0) FROM ({plays}) plays
WHERE CAST(ts AS DATE) BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY genre"""


ORACLE: dict[str, str] = {
    "daily_minutes": DAILY,
    "hourly_minutes": HOURLY,
    "minute_minutes": _sums(
        EVENT_PLAYS, "strftime(ts, '%Y-%m-%d %H:%M')", "ymdhm", *_MONTH_LENGTH, zero=False
    ),
    "month_day_rows": _month_rows(*_YEARS),
    "monthly_minutes": MONTHLY,
    "genre_totals": TOTALS,
    "genre_order": GENRE_ORDER,
    "ranked_table": f"""
SELECT days.*, genre_rank FROM ({DAILY}) days JOIN ({GENRE_ORDER}) ranks
  ON days.genre IS NOT DISTINCT FROM ranks.genre""",
    "play_minutes": _sums(LINEITEM_PLAYS, _DAY, "Date", "1998-03-01", "1998-03-31"),
    "play_minutes_by_hour": HOURS_OF_DAY,
    "play_minutes_by_month": _month_rows(*_YEAR),
    "play_series": _sums(LINEITEM_PLAYS, _MONTH, "Month", *_YEAR),
    "display_table": f"""
SELECT strftime("Date", '%d/') || month("Date") || '/' || year("Date") AS "Date",
       strftime("Date", '%d %b') AS axis_label, genre, minsplayed
FROM ({DAILY}) days""",
    "display_table_hours": f"""
SELECT hour("Time") || ':00' AS "Time", strftime("Time", '%H:%M') AS axis_label, genre, minsplayed
FROM ({HOURS_OF_DAY}) hours""",
    "display_table_months": f"""
SELECT month("Month") || '/' || year("Month") AS "Month", strftime("Month", '%b') AS axis_label, genre, minsplayed
FROM ({MONTHLY}) months""",
    "top_page": f'{DAILY} ORDER BY minsplayed DESC NULLS LAST, "Date", genre LIMIT 10',
    "next_page": f'{DAILY} ORDER BY minsplayed DESC NULLS LAST, "Date", genre LIMIT 10 OFFSET 10',
    "seek_page": f'{DAILY} ORDER BY minsplayed DESC NULLS LAST, "Date", genre LIMIT 10 OFFSET 20',
    "all_parts": _parts(
        _sums(LINEITEM_PLAYS, _DAY, "Date", *_YEAR, zero=False), _sums(LINEITEM_PLAYS, _MONTH, "Month", *_YEAR), LINEITEM_PLAYS, *_YEAR
    ),
    "all_parts_by_hour": _parts(HOURS_OF_DAY, None, EVENT_PLAYS, "2024-01-10", "2024-01-10"),
    "raw_window": WINDOW,
    "validate_requests": VALIDATED,
    "accepted_reads": f'SELECT dataset, "timestamp", "user", import_from, import_to FROM ({ACCEPTED}) accepted',
    "customer_extract": f"""
{EVENT_ROWS} WHERE "customerID" = '149' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'""",
    "source_extract": f"""
{KEYED_ROWS} WHERE "customerID" = '149' AND ymd BETWEEN '2024-01-08' AND '2024-01-21'""",
    "clustered_extract": f"""
{KEYED_ROWS} WHERE "customerID" = '149' AND ymd BETWEEN '2024-01-08' AND '2024-01-21'""",
    "long_extract": f"""
SELECT dataset, "customerID", genre, CAST(minsplayed AS DOUBLE) AS minsplayed, ts
FROM ({_request_rows(LONG_REQUESTS, LINEITEM_PLAYS)}) extracts""",
    "long_counts": _request_sums(LONG_REQUESTS, LINEITEM_PLAYS),
    "mixed_layouts": _sums(
        f"""
SELECT * REPLACE (CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'
                       THEN CAST(floor(minsplayed) AS DECIMAL(18,2)) ELSE minsplayed END AS minsplayed)
FROM ({EVENT_PLAYS}) plays""",
        _DAY,
        "Date",
        *_MONTH_LENGTH,
    ),
    "daily_coverage": f"""
WITH spine AS (
  SELECT CAST(day AS DATE) AS day
  FROM generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-21', INTERVAL 1 DAY) AS days(day)),
counts AS (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM ({EVENT_PLAYS}) plays WHERE "customerID" = '149' GROUP BY 1)
SELECT day, coalesce(n, 0) AS n_rows, coalesce(n, 0) > 0 AS has_data FROM spine LEFT JOIN counts USING (day)""",
    "batch_coverage": COVERAGE,
    "batch_extract": f"""
SELECT dataset, "customerID", genre, CAST(minsplayed AS DOUBLE) AS minsplayed, ts
FROM ({_request_rows(REQUESTS, EVENT_PLAYS)}) extracts""",
    "source_batch": f"""
SELECT * EXCLUDE (ts) FROM ({_request_rows(LATE_REQUESTS, KEYED_EVENTS)}) extracts""",
    "source_coverage": COVERAGE,
    "source_window": f"""
SELECT "customerID", genre, minsplayed, ym, ymd, ymdh, ymdhm FROM ({KEYED_EVENTS}) keyed
WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-10 22:00:00' AND TIMESTAMP '2024-01-11 04:00:00'""",
    "request_counts": _request_sums(LATE_REQUESTS),
    "extract_report": REPORT,
    "merge_days": f"{KEYED_ROWS} WHERE ymd BETWEEN '2024-01-08' AND '2024-01-10'",
    "write_roundtrip": KEYED_ROWS,
    "append_roundtrip": KEYED_ROWS,
    "load_range": _sums(EVENT_PLAYS, _DAY, "Date", "2024-01-05", "2024-01-10"),
    "loaded_hours": HOURLY,
    "compact_roundtrip": KEYED_ROWS,
    "dataset_catalog": CATALOG,
    "dataset_listing": f"SELECT dataset, CAST(1 AS BIGINT) AS n_files, true AS has_data FROM ({CATALOG}) written",
    "stored_report": REPORT,
    "batch_report": BATCH_REPORT,
    "known_coverage": COVERAGE,
    "packed_store": f"{KEYED_ROWS} WHERE ymd BETWEEN '2024-01-05' AND '2024-01-25'",
    "store_minutes": _request_sums(REQUESTS),
    "store_drift": "SELECT 'part-' || k AS commit, 'unknown' AS state, true AS found FROM range(3) parts(k)",
    "double_minutes": f'SELECT "Date", genre, round(minsplayed, 6) AS minsplayed FROM ({DAILY}) days',
    "cached_view": _sums(EVENT_PLAYS, _DAY, "Date", "2024-01-05", "2024-01-20"),
    "csv_buckets": HOURLY,
    "csv_totals": TOTALS,
    "csv_window": WINDOW,
    "csv_roundtrip": KEYED_ROWS,
    "log_append": f"{REQUEST_LOG_ROWS} UNION ALL {REQUEST_LOG_ROWS}",
    "read_log_append": f"""
SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", "user", dataset AS "datasetID",
       CAST(import_from AS VARCHAR) AS "from", CAST(import_to AS VARCHAR) AS "to"
FROM ({ACCEPTED}) accepted""",
}
