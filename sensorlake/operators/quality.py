"""Data-quality checks on readings, from the rules the sensor generator follows.

``range_flags`` and ``temperature_residual`` are row-local (streaming-safe);
``step_flags`` compares each reading with the previous one of its sensor (batch only;
``streaming.steps.step_flags_stream`` does so on a stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from sensorlake.functions.time import diurnal_baseline, utc_wall_clock
from sensorlake.operators.sequence import DEFAULT_ROWS_PER_SLICE, with_previous

# The generator's bounds.
PM_MIN = 0.0
CO2_MIN, CO2_MAX = 400.0, 2000.0
HUMIDITY_MIN, HUMIDITY_MAX = 30.0, 90.0
PM_STEP = (-1.0, 1.0)
CO2_STEP = (-1.0, 3.0)
HUMIDITY_STEP_WARM = (-0.8, 0.2)  # temperature above 24
HUMIDITY_STEP_COOL = (-0.2, 0.8)
WARM_ABOVE = 24.0
TEMPERATURE_NOISE = 0.3
STEP_METRICS = ["pm25", "pm10", "co2", "humidity"]
# Slack for rounding to two places and float32 storage.
STEP_SLACK = 0.006
RESIDUAL_SLACK = 0.005


def range_flags(df: DataFrame) -> DataFrame:
    """Add ``<metric>_in_range`` booleans (NULL when the metric is NULL)."""
    return df.select(
        "*",
        (F.col("pm25") >= PM_MIN).alias("pm25_in_range"),
        (F.col("pm10") >= PM_MIN).alias("pm10_in_range"),
        F.col("co2").between(CO2_MIN, CO2_MAX).alias("co2_in_range"),
        F.col("humidity").between(HUMIDITY_MIN, HUMIDITY_MAX).alias("humidity_in_range"),
    )


def _within(c, lo: float, hi: float):
    return c.between(lo - STEP_SLACK, hi + STEP_SLACK)


def step_flags(
    df: DataFrame,
    sensor="sensor",
    ts: str = "timestamp",
    tiebreak=("event_id",),
    rows_per_slice: int | None = DEFAULT_ROWS_PER_SLICE,
) -> DataFrame:
    """Add per-metric steps from the previous reading of the same sensor and whether
    each step is one the generator can make. The humidity bound depends on the
    current reading's temperature (strictly above 24 is warm; NULL counts as cool).
    First reading of a sensor: NULL steps and flags (batch only)."""
    tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    prev = with_previous(df, sensor, [ts, *tb], STEP_METRICS, prefix="_prev_", rows_per_slice=rows_per_slice)
    return flags_from_previous(prev)


def flags_from_previous(prev: DataFrame) -> DataFrame:
    """Replace ``_prev_<metric>`` (the previous reading's) by the steps and their flags."""
    d = {m: F.col(m).cast("double") - F.col(f"_prev_{m}").cast("double") for m in STEP_METRICS}
    warm = F.col("temperature") > WARM_ABOVE
    hum_ok = F.when(
        d["humidity"].isNotNull(),
        F.when(warm, _within(d["humidity"], *HUMIDITY_STEP_WARM)).otherwise(
            _within(d["humidity"], *HUMIDITY_STEP_COOL)
        ),
    )
    return prev.select(
        *[c for c in prev.columns if not c.startswith("_prev_")],
        *[d[m].alias(f"{m}_step") for m in STEP_METRICS],
        _within(d["pm25"], *PM_STEP).alias("pm25_step_ok"),
        _within(d["pm10"], *PM_STEP).alias("pm10_step_ok"),
        _within(d["co2"], *CO2_STEP).alias("co2_step_ok"),
        hum_ok.alias("humidity_step_ok"),
    )


def temperature_residual(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add the departure of temperature from the diurnal baseline and whether it is
    beyond the generator's noise (``abs > 0.3`` plus rounding slack). The hour is that of
    UTC, whatever the session's zone."""
    clock = utc_wall_clock(ts) if isinstance(df.schema[ts].dataType, TimestampType) else F.col(ts)
    resid = F.col("temperature").cast("double") - diurnal_baseline(clock)
    return df.select(
        "*",
        resid.alias("temperature_residual"),
        (F.abs(resid) > F.lit(TEMPERATURE_NOISE + RESIDUAL_SLACK)).alias("temperature_off_baseline"),
    )
