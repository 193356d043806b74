"""SQL twins of the catalog queries, for a SQL engine reading the same tables (DuckDB
dialect; ``events`` is a view over the Parquet file). Column names and types match the
Spark results: floats widened to double, timestamps without zone."""

from __future__ import annotations

from sensorlake.operators.quality import (
    CO2_MAX,
    CO2_MIN,
    CO2_STEP,
    HUMIDITY_MAX,
    HUMIDITY_MIN,
    HUMIDITY_STEP_COOL,
    HUMIDITY_STEP_WARM,
    PM_STEP,
    RESIDUAL_SLACK,
    STEP_SLACK,
    TEMPERATURE_NOISE,
    WARM_ABOVE,
)
from sensorlake.plans.catalog import (
    AS_OF,
    HOT_EVERY,
    HOT_SENSOR,
    CSV_MAXROWS,
    CSV_SKIPROWS,
    EPOCH_SHIFT_MS,
    LATEST_N,
    LOOKUP_EVENT_ID,
    PAGE_AFTER,
    PAGE_SIZE,
    TABLE_PAGES,
)
from sensorlake.functions.time import MAX_EPOCH_MS, MIN_EPOCH_MS
from sensorlake.schema import TOPIC


def _d(x: float) -> str:
    """A double literal that parses to exactly the Python float."""
    return f"{x!r}::DOUBLE"


READINGS = f"""
src AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
r AS (
  SELECT event_id, user_id AS sensor, k, value AS raw_value, event_type,
    CAST(value AS FLOAT) AS pm25,
    CAST(value * 1.5::DOUBLE AS FLOAT) AS pm10,
    CAST(360.0::DOUBLE + 17.0::DOUBLE * k AS FLOAT) AS co2,
    CAST(17.0::DOUBLE + 0.1::DOUBLE * k AS FLOAT) AS temperature,
    CAST(25.0::DOUBLE + 0.7::DOUBLE * k AS FLOAT) AS humidity,
    ts AS "timestamp",
    md5(concat_ws('|', '{TOPIC}', CAST(user_id % 8 AS VARCHAR), CAST(event_id AS VARCHAR))) AS h
  FROM src
),
rid AS (
  SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
            || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
  FROM r
)
"""

W = "CAST(pm25 AS DOUBLE) AS pm25, CAST(pm10 AS DOUBLE) AS pm10, CAST(co2 AS DOUBLE) AS co2, " \
    "CAST(temperature AS DOUBLE) AS temperature, CAST(humidity AS DOUBLE) AS humidity"
REPORT = f'id, {W}, "timestamp"'


def _with(body: str) -> str:
    return f"WITH {READINGS} {body}"


def _between(col: str, lo: float, hi: float) -> str:
    return f"{col} BETWEEN {_d(lo - STEP_SLACK)} AND {_d(hi + STEP_SLACK)}"


_STEP = """
steps AS (
  SELECT event_id, temperature,
    CAST(pm25 AS DOUBLE) - lag(CAST(pm25 AS DOUBLE)) OVER w AS pm25_step,
    CAST(pm10 AS DOUBLE) - lag(CAST(pm10 AS DOUBLE)) OVER w AS pm10_step,
    CAST(co2 AS DOUBLE) - lag(CAST(co2 AS DOUBLE)) OVER w AS co2_step,
    CAST(humidity AS DOUBLE) - lag(CAST(humidity AS DOUBLE)) OVER w AS humidity_step
  FROM r
  WINDOW w AS (PARTITION BY sensor ORDER BY "timestamp", event_id)
)
"""

_STEP_STORED = (
    _STEP.replace("SELECT event_id, temperature", "SELECT id, CAST(sensor AS VARCHAR) AS sensor, temperature")
    .replace("FROM r\n", "FROM rid\n")
    .replace('ORDER BY "timestamp", event_id', 'ORDER BY "timestamp", id')
)

_STEP_HOT = _STEP.replace(
    "FROM r\n", f"FROM (SELECT * REPLACE (CASE WHEN event_id % {HOT_EVERY} = 0 THEN {HOT_SENSOR} ELSE sensor END AS sensor) FROM r)\n"
)

_BASELINE = (
    f"(22.0::DOUBLE + 5.0::DOUBLE * sin({_d(2 * 3.141592653589793 / 24)} * "
    f'((hour("timestamp") + minute("timestamp") / 60.0::DOUBLE) - 6.0::DOUBLE)))'
)

_NUMBER_TEXT = "translate(format('{:,.2f}', raw_value * 1000.0::DOUBLE), ',.', '.,')"


def _trim_zeros(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '0+$', ''), '\\.$', '')"


_PM10_TEXT = _trim_zeros("printf('%.5f', CAST(pm10 AS DOUBLE))")
_VALUE_TEXT = _trim_zeros("printf('%.12f', CAST(event_id AS DOUBLE) / 1024.0::DOUBLE)")
_GROUPED_TEXT = _trim_zeros("format('{:,.2f}', CAST(co2 AS DOUBLE) * 1000.0::DOUBLE)")

ORACLE: dict[str, str] = {
    "decode_readings": _with(f'SELECT event_id, {W}, "timestamp" FROM r'),
    "props_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "stream_ingest": _with(f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid'),
    "stream_restart": _with(f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid'),
    "stream_new_checkpoint": _with(f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid'),
    "stream_compact_stream": _with(f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid'),
    "stream_then_copy": _with(
        f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid UNION ALL '
        f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid'
    ),
    "stored_step_flags": _with(
        f", {_STEP_STORED} SELECT id, sensor, round(co2_step, 6) AS co2_step, "
        f"{_between('pm25_step', *PM_STEP)} AS pm25_step_ok, {_between('co2_step', *CO2_STEP)} AS co2_step_ok, "
        f"CASE WHEN humidity_step IS NULL THEN NULL WHEN temperature > {WARM_ABOVE} "
        f"THEN {_between('humidity_step', *HUMIDITY_STEP_WARM)} "
        f"ELSE {_between('humidity_step', *HUMIDITY_STEP_COOL)} END AS humidity_step_ok FROM steps"
    ),
    "stream_step_flags": _with(
        f", {_STEP_STORED} SELECT id, sensor, round(co2_step, 6) AS co2_step, "
        f"{_between('pm25_step', *PM_STEP)} AS pm25_step_ok, {_between('co2_step', *CO2_STEP)} AS co2_step_ok, "
        f"CASE WHEN humidity_step IS NULL THEN NULL WHEN temperature > {WARM_ABOVE} "
        f"THEN {_between('humidity_step', *HUMIDITY_STEP_WARM)} "
        f"ELSE {_between('humidity_step', *HUMIDITY_STEP_COOL)} END AS humidity_step_ok FROM steps"
    ),
    "table_pages_all": _with(
        ', t AS (SELECT id, CASE WHEN event_id % 10 <> 0 THEN "timestamp" END AS "timestamp" FROM rid), '
        'n AS (SELECT *, row_number() OVER (ORDER BY "timestamp" NULLS FIRST, id) - 1 AS place FROM t) '
        f'SELECT id, "timestamp", CAST(place // (((SELECT count(*) FROM events) + {TABLE_PAGES - 1}) // {TABLE_PAGES}) AS INTEGER) AS page FROM n'
    ),
    "compacted_table": _with(f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid'),
    "dashboard": _with(
        'SELECT "timestamp" AS "Timestamp", CAST(pm25 AS DOUBLE) AS "PM2.5", CAST(pm10 AS DOUBLE) AS "PM10", '
        'CAST(co2 AS DOUBLE) AS "CO2", CAST(temperature AS DOUBLE) AS "Temperature", '
        f'CAST(humidity AS DOUBLE) AS "Humidity" FROM rid ORDER BY "timestamp" DESC, id LIMIT {LATEST_N}'
    ),
    "stable_id": _with("SELECT event_id, id FROM rid"),
    "random_id": "SELECT count(*) AS n_rows, count(*) AS n_ids, 36 AS min_len, 36 AS max_len FROM events",
    "latest_100": _with(f'SELECT {REPORT} FROM rid ORDER BY "timestamp" DESC, id LIMIT {LATEST_N}'),
    "take_any": f"SELECT least(count(*), {LATEST_N}) AS n_rows, least(count(*), {LATEST_N}) AS n_ids FROM events",
    "sample_then_sort": f"SELECT least(count(*), {LATEST_N}) AS n_rows, least(count(*), {LATEST_N}) AS n_ids, "
    "true AS newest_first FROM events",
    "newest_first": _with(f"SELECT {REPORT} FROM rid"),
    "presentation": _with(
        'SELECT "timestamp" AS "Timestamp", CAST(pm25 AS DOUBLE) AS "PM2.5", CAST(pm10 AS DOUBLE) AS "PM10", '
        'CAST(co2 AS DOUBLE) AS "CO2", CAST(temperature AS DOUBLE) AS "Temperature", '
        f'CAST(humidity AS DOUBLE) AS "Humidity" FROM rid ORDER BY "timestamp" DESC, id LIMIT {LATEST_N}'
    ),
    "point_lookup": _with(f'SELECT event_id, {W}, "timestamp" FROM r WHERE event_id = {LOOKUP_EVENT_ID}'),
    "page_3": _with(
        f'SELECT event_id, {W}, "timestamp" FROM r WHERE event_id > {PAGE_AFTER} ORDER BY event_id LIMIT {PAGE_SIZE}'
    ),
    "table_page": _with(
        f', x AS (SELECT "timestamp" AS t0, id AS i0 FROM rid WHERE event_id = {PAGE_AFTER}) '
        f'SELECT {REPORT} FROM rid, x WHERE "timestamp" > t0 OR ("timestamp" = t0 AND id > i0) '
        f'ORDER BY "timestamp", id LIMIT {PAGE_SIZE}'
    ),
    "row_numbers": _with(
        'SELECT event_id, sensor, row_number() OVER (PARTITION BY sensor ORDER BY "timestamp", event_id) '
        "AS row_number FROM r"
    ),
    "row_numbers_global": _with(
        'SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) AS row_number FROM r'
    ),
    "row_numbers_hot_sensor": _with(
        f", h AS (SELECT *, CASE WHEN event_id % {HOT_EVERY} = 0 THEN {HOT_SENSOR} ELSE sensor END AS hot FROM r) "
        'SELECT event_id, hot AS sensor, row_number() OVER (PARTITION BY hot ORDER BY "timestamp", event_id) '
        "AS row_number FROM h"
    ),
    "step_flags_hot_sensor": _with(
        f", {_STEP_HOT} SELECT event_id, round(pm25_step, 6) AS pm25_step, round(pm10_step, 6) AS pm10_step, "
        "round(co2_step, 6) AS co2_step, round(humidity_step, 6) AS humidity_step, "
        f"{_between('pm25_step', *PM_STEP)} AS pm25_step_ok, "
        f"{_between('pm10_step', *PM_STEP)} AS pm10_step_ok, "
        f"{_between('co2_step', *CO2_STEP)} AS co2_step_ok, "
        f"CASE WHEN humidity_step IS NULL THEN NULL WHEN temperature > {WARM_ABOVE} "
        f"THEN {_between('humidity_step', *HUMIDITY_STEP_WARM)} "
        f"ELSE {_between('humidity_step', *HUMIDITY_STEP_COOL)} END AS humidity_step_ok FROM steps"
    ),
    "row_numbers_outlier": _with(
        f"SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id = 1 THEN TIMESTAMP '9999-01-01' "
        f"WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN TIMESTAMP '{AS_OF.isoformat(sep=' ')}' "
        'ELSE "timestamp" END NULLS FIRST, event_id) AS row_number FROM r'
    ),
    "row_count": "SELECT count(*) AS n_rows FROM events",
    "unpivot": _with(
        " UNION ALL ".join(
            f"SELECT event_id, \"timestamp\", '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM r"
            for m in ("pm25", "pm10", "co2", "temperature", "humidity")
        )
    ),
    "select_columns": _with('SELECT id, CAST(pm25 AS DOUBLE) AS pm25, CAST(temperature AS DOUBLE) AS temperature, '
                            'CAST(humidity AS DOUBLE) AS humidity, "timestamp" FROM rid'),
    "split_good": _with(f'SELECT event_id, {W}, "timestamp" FROM r WHERE event_id % 10 <> 0'),
    "split_bad": "SELECT event_id, 'not json' AS body, 'malformed_json' AS reason FROM events WHERE event_id % 10 = 0",
    "error_summary": """
WITH bad AS (
  SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE event_id % 10 = 0
)
SELECT 'malformed_json' AS reason, count(*) AS errors,
  max(CASE WHEN rn = 1 THEN event_id END) AS sample_1_order,
  max(CASE WHEN rn = 1 THEN 'not json' END) AS sample_1,
  max(CASE WHEN rn = 2 THEN event_id END) AS sample_2_order,
  max(CASE WHEN rn = 2 THEN 'not json' END) AS sample_2,
  greatest(count(*) - 2, 0) AS suppressed
FROM bad
""",
    "error_summary_ties": """
WITH bad AS (
  SELECT CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS reason, event_id % 7 AS o, event_type AS b FROM events
), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY o, b) AS rn FROM bad)
SELECT reason, count(*) AS errors,
  max(CASE WHEN rn = 1 THEN o END) AS sample_1_order, max(CASE WHEN rn = 1 THEN b END) AS sample_1,
  max(CASE WHEN rn = 2 THEN o END) AS sample_2_order, max(CASE WHEN rn = 2 THEN b END) AS sample_2,
  greatest(count(*) - 2, 0) AS suppressed
FROM n GROUP BY reason
""",
    "csv_roundtrip": _with(
        f'SELECT event_id, {W}, "timestamp", co2 BETWEEN {CO2_MIN} AND {CO2_MAX} AS co2_in_range FROM r'
    ),
    "csv_stream_import": _with(
        f'SELECT event_id, sensor, {W}, "timestamp", co2 BETWEEN {CO2_MIN} AND {CO2_MAX} AS co2_in_range FROM r'
    ),
    "csv_bad_lines": """
SELECT event_id || CASE event_id % 4 WHEN 1 THEN ',"x, y",  not a number ' WHEN 2 THEN ',short' ELSE ',x,2,extra' END AS line,
  CASE event_id % 4 WHEN 1 THEN 'bad_value:n' ELSE 'malformed_line' END AS reason
FROM events WHERE event_id % 4 <> 0
""",
    "csv_encoding_skip": "SELECT event_id, 'é' || event_type || 'ü' AS t FROM events ORDER BY event_id "
    f"LIMIT {CSV_MAXROWS} OFFSET {CSV_SKIPROWS}",
    "csv_multiline": "SELECT event_id, event_type || chr(10) || '\"a\", ' || event_id AS t FROM events",
    "csv_skip_max": _with(
        f'SELECT event_id, sensor, {W}, "timestamp", co2 BETWEEN {CO2_MIN} AND {CO2_MAX} AS co2_in_range '
        f"FROM r ORDER BY event_id LIMIT {CSV_MAXROWS} OFFSET {CSV_SKIPROWS}"
    ),
    "stored_lookup": _with(
        f'SELECT {REPORT}, CAST("timestamp" AS DATE) AS reading_date FROM rid WHERE event_id = {LOOKUP_EVENT_ID}'
    ),
    "token_ranges": _with(f'SELECT event_id, sensor, {W}, "timestamp" FROM r'),
    "csv_odd_names": _with(
        f'SELECT event_id, sensor, {W}, "timestamp", co2 BETWEEN {CO2_MIN} AND {CO2_MAX} AS co2_in_range '
        f"FROM r ORDER BY event_id LIMIT {CSV_MAXROWS} OFFSET {CSV_SKIPROWS}"
    ),
    "csv_control_chars": "SELECT event_id, c || ' y' || c || 'z ' || c AS t FROM (SELECT event_id, "
    "chr(CAST(CASE event_id % 30 WHEN 10 THEN 30 WHEN 13 THEN 31 ELSE event_id % 30 END AS INTEGER)) AS c FROM events)",
    "append_result": _with(f"SELECT {REPORT} FROM rid UNION ALL SELECT {REPORT} FROM rid"),
    "hash_range_cover": "SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_distinct FROM events",
    "expiry": f"""
WITH e AS (
  SELECT event_id, ts + to_seconds(CASE WHEN k % 7 = 0 THEN NULL ELSE k * 3600 END) AS expires_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)
SELECT event_id, expires_at FROM e
WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF.isoformat(sep=' ')}'
""",
    "epoch_ms": f"""
WITH m AS (
  SELECT event_id,
    epoch_us(ts) // 1000 + CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) - 50 AS BIGINT) * {EPOCH_SHIFT_MS} AS ms
  FROM events
)
SELECT event_id,
  CASE WHEN ms BETWEEN {MIN_EPOCH_MS} AND {MAX_EPOCH_MS} THEN make_timestamp(ms * 1000) END AS ts,
  CASE WHEN ms NOT BETWEEN {MIN_EPOCH_MS} AND {MAX_EPOCH_MS} THEN ms END AS raw_ms
FROM m
""",
    "parse_number": _with(
        "SELECT event_id, TRY_CAST(replace(replace(txt, '.', ''), ',', '.') AS DOUBLE) AS number FROM ("
        f"SELECT event_id, CASE WHEN event_type = 'error' THEN {_NUMBER_TEXT} || 'x' ELSE {_NUMBER_TEXT} END AS txt FROM r)"
    ),
    "parse_bool": """
SELECT event_id,
  CASE lower(CASE event_type WHEN 'click' THEN 'YES' WHEN 'view' THEN 'no' WHEN 'purchase' THEN 'Yes'
                  ELSE event_type END)
    WHEN 'yes' THEN true WHEN 'no' THEN false END AS flag
FROM events
""",
    "format_columns": _with(
        "SELECT event_id, "
        f"{_PM10_TEXT} AS pm10_text, {_VALUE_TEXT} AS value_text, {_GROUPED_TEXT} AS grouped_text, "
        "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS ts_text FROM r"
    ),
    "format_exact": "SELECT event_id, printf('%.3f', (event_id::DOUBLE + 0.5::DOUBLE) / 8.0::DOUBLE) AS tie_text, "
    "printf('%.3f', (event_id::DOUBLE * 2 + 1) / -2000.0::DOUBLE) AS near_tie_text, "
    "printf('%.0f', event_id::DOUBLE + 0.5::DOUBLE) AS whole_text, "
    "printf('%.6f', value * 1e9::DOUBLE) AS large_text FROM events",
    "clamp_round": _with(
        "SELECT event_id, round(CAST(pm25 AS DOUBLE) / 3.0::DOUBLE, 2) AS pm25_third, "
        "CAST(least(greatest(pm10, 5.0), 50.0) AS DOUBLE) AS pm10_clamped, "
        "CAST(least(greatest(humidity, 30.0), 90.0) AS DOUBLE) AS humidity_clamped FROM r"
    ),
    "range_flags": _with(
        "SELECT event_id, pm25 >= 0 AS pm25_in_range, pm10 >= 0 AS pm10_in_range, "
        f"co2 BETWEEN {CO2_MIN} AND {CO2_MAX} AS co2_in_range, "
        f"humidity BETWEEN {HUMIDITY_MIN} AND {HUMIDITY_MAX} AS humidity_in_range FROM r"
    ),
    "step_flags": _with(
        f", {_STEP} SELECT event_id, round(pm25_step, 6) AS pm25_step, round(pm10_step, 6) AS pm10_step, "
        "round(co2_step, 6) AS co2_step, round(humidity_step, 6) AS humidity_step, "
        f"{_between('pm25_step', *PM_STEP)} AS pm25_step_ok, "
        f"{_between('pm10_step', *PM_STEP)} AS pm10_step_ok, "
        f"{_between('co2_step', *CO2_STEP)} AS co2_step_ok, "
        f"CASE WHEN humidity_step IS NULL THEN NULL WHEN temperature > {WARM_ABOVE} "
        f"THEN {_between('humidity_step', *HUMIDITY_STEP_WARM)} "
        f"ELSE {_between('humidity_step', *HUMIDITY_STEP_COOL)} END AS humidity_step_ok FROM steps"
    ),
    "temperature_residual": _with(
        f"SELECT event_id, round(CAST(temperature AS DOUBLE) - {_BASELINE}, 6) AS temperature_residual, "
        f"abs(CAST(temperature AS DOUBLE) - {_BASELINE}) > {_d(TEMPERATURE_NOISE + RESIDUAL_SLACK)} "
        "AS temperature_off_baseline FROM r"
    ),
}
