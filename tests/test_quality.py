"""Quality checks on hand-written rows, at and just beyond each bound."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest

from sensorlake.operators.quality import range_flags, step_flags, temperature_residual

SCHEMA = "event_id long, sensor long, pm25 float, pm10 float, co2 float, temperature float, humidity float, timestamp timestamp"
NOON = datetime(2024, 1, 1, 12, 0)


def reading(i, pm25=10.0, pm10=20.0, co2=500.0, temperature=20.0, humidity=50.0, sensor=1, at=None):
    return (i, sensor, pm25, pm10, co2, temperature, humidity, at or datetime(2024, 1, 1, 0, 0, i))


def test_range_flags_null_stays_null(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0, 399.0, 20.0, 95.0, None)], SCHEMA)
    r = range_flags(df).first()
    assert r.pm25_in_range is None and r.pm10_in_range is True and r.co2_in_range is False and r.humidity_in_range is False


@pytest.mark.parametrize(
    "column, inside, outside",
    [
        ("pm25", [0.0, 900.0], [-0.01]),
        ("pm10", [0.0], [-0.01]),
        ("co2", [400.0, 2000.0], [399.99, 2000.01]),
        ("humidity", [30.0, 90.0], [29.99, 90.01]),
    ],
)
def test_ranges_at_their_bounds(spark, column, inside, outside):
    values = inside + outside
    df = spark.createDataFrame([reading(i, **{column: v}) for i, v in enumerate(values)], SCHEMA)
    got = {r.event_id: r[f"{column}_in_range"] for r in range_flags(df).collect()}
    assert got == {i: v in inside for i, v in enumerate(values)}


@pytest.mark.parametrize(
    "column, temperature, inside, outside",
    [
        ("pm25", 20.0, [-1.0, 0.0, 1.0], [-1.02, 1.02]),
        ("pm10", 20.0, [-1.0, 1.0], [-1.02, 1.02]),
        ("co2", 20.0, [-1.0, 3.0], [-1.02, 3.02]),
        ("humidity", 24.01, [-0.8, 0.2], [-0.82, 0.22]),
        ("humidity", 24.0, [-0.2, 0.8], [-0.22, 0.82]),
        ("humidity", None, [-0.2, 0.8], [-0.22, 0.82]),
    ],
)
def test_steps_at_their_bounds(spark, column, temperature, inside, outside):
    start = {"pm25": 10.0, "pm10": 20.0, "co2": 500.0, "humidity": 50.0}[column]
    rows, want = [], {}
    for s, step in enumerate(inside + outside):  # two readings of a sensor for each step
        rows += [
            reading(2 * s, sensor=s, temperature=temperature),
            reading(2 * s + 1, sensor=s, temperature=temperature, **{column: start + step}),
        ]
        want |= {2 * s: None, 2 * s + 1: step in inside}
    got = step_flags(spark.createDataFrame(rows, SCHEMA), "sensor", "timestamp", ("event_id",)).collect()
    assert {r.event_id: r[f"{column}_step_ok"] for r in got} == want


def test_steps_are_taken_within_a_sensor_and_from_null_to_null(spark):
    rows = [reading(0, sensor=1), reading(1, sensor=2, co2=900.0), reading(2, sensor=1, co2=None), reading(3, sensor=1)]
    got = {r.event_id: r for r in step_flags(spark.createDataFrame(rows, SCHEMA), "sensor", "timestamp", ("event_id",)).collect()}
    assert got[1].co2_step is None and got[2].co2_step_ok is None and got[3].co2_step_ok is None
    assert got[2].pm25_step_ok is True and got[3].pm25_step_ok is True


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_residual_at_its_bound_in_any_session_zone(spark, zone):
    # The baseline is highest, 27 degrees, at 12:00 UTC.
    values = {27.0: False, 27.3: False, 26.7: False, 27.31: True, 26.69: True}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = NOON.replace(tzinfo=timezone.utc)
        df = spark.createDataFrame([reading(i, temperature=v, at=at) for i, v in enumerate(values)], SCHEMA)
        got = {r.event_id: r.temperature_off_baseline for r in temperature_residual(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == dict(enumerate(values.values()))
