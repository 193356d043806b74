"""Scalar column functions (JVM-side expressions, no Python UDF)."""

from sensorlake.functions.numbers import (
    clamp,
    fixed_text,
    format_number,
    localize,
    parse_number,
    round2,
)
from sensorlake.functions.text import (
    format_bool,
    norm_name,
    parse_bool,
    stable_uuid,
)
from sensorlake.functions.time import (
    decode_epoch_ms,
    diurnal_baseline,
    format_ts,
    hour_of_day,
    iso_ts,
    ntz_literal,
    parse_ts,
    strftime_to_spark,
    ts_micros,
    utc_wall_clock,
)

__all__ = [
    "clamp",
    "decode_epoch_ms",
    "diurnal_baseline",
    "fixed_text",
    "format_bool",
    "format_number",
    "format_ts",
    "hour_of_day",
    "iso_ts",
    "localize",
    "norm_name",
    "ntz_literal",
    "parse_bool",
    "parse_number",
    "parse_ts",
    "round2",
    "stable_uuid",
    "strftime_to_spark",
    "ts_micros",
    "utc_wall_clock",
]
