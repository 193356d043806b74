"""Timestamp parsing, formatting and the diurnal temperature baseline."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F



def ntz_literal(value: datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal built from text, so no zone is involved (a Python
    datetime literal would be read in the process zone, then shifted by the session's)."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def _epoch_ntz() -> Column:
    return ntz_literal("1970-01-01 00:00:00")

# The datetime range a client can render (years 1..9999), in epoch ms.
MIN_EPOCH_MS = -62135596800000
MAX_EPOCH_MS = 253402300799999

# Strftime directives accepted in DATETIMEFORMAT and their Spark patterns.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%z": "xx",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c, ntz: bool = False) -> Column:
    """ISO-8601 text to timestamp, NULL when malformed (never raises under ANSI).

    Text without a zone is UTC, whatever the session zone; text with one is that instant.
    ``ntz=True`` yields TIMESTAMP_NTZ, read as a wall clock and free of the session zone.
    """
    text = _col(c)
    if ntz:
        return text.try_cast("timestamp_ntz")
    # With a second zone behind its own the text isn't a timestamp, and is taken as it is.
    return F.coalesce(F.concat(text, F.lit("Z")).try_cast("timestamp"), text.try_cast("timestamp"))


def iso_ts(c) -> Column:
    """Timestamp to ISO text the way Python's ``isoformat`` writes it: the fraction is
    left out when the microseconds are zero."""
    full = F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.endswith(full, F.lit(".000000")), F.substring(full, 1, 19)).otherwise(full)


def strftime_to_spark(fmt: str) -> str:
    """Translate a strftime format into a Spark datetime pattern.

    Literal text is quoted; unsupported directives raise ``ValueError``.
    """
    out: list[str] = []
    literal: list[str] = []

    def flush() -> None:
        if literal:
            text = "".join(literal)
            # Letters and a few symbols are pattern syntax; other characters are literal.
            if any(ch.isalpha() or ch in "[]{}#'" for ch in text):
                text = "'" + text.replace("'", "''") + "'"
            out.append(text)
            literal.clear()

    i = 0
    while i < len(fmt):
        if fmt[i] == "%":
            d = fmt[i : i + 2]
            if d == "%%":
                literal.append("%")
            elif d in STRFTIME_TO_SPARK:
                flush()
                out.append(STRFTIME_TO_SPARK[d])
            else:
                raise ValueError(f"unsupported strftime directive {d!r} in {fmt!r}")
            i += 2
        else:
            literal.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


def format_ts(c, strftime: str, tz: str | None = None, ntz: bool = False) -> Column:
    """Timestamp to text by a strftime format.

    Without ``tz``: an instant renders in the session zone (``%z`` its offset), a wall
    clock (``ntz=True``) as it is, with ``%z`` as +0000. With ``tz`` (a region id such
    as ``Europe/Berlin``): the wall clock in that zone, ``%z`` its offset at that
    instant (so daylight saving shows). A wall clock input is read as UTC.
    """
    c = _col(c)
    if tz is None:
        if ntz:
            return F.date_format(c, strftime_to_spark(strftime.replace("%z", "+0000")))
        return F.date_format(c, strftime_to_spark(strftime))
    utc_wall = c if ntz else utc_wall_clock(c)
    wall = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall)
    minutes = F.timestamp_diff("MINUTE", utc_wall, wall)
    offset = F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"),
        F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"),
    )
    pieces = []
    for i, part in enumerate(strftime.split("%z")):
        if i:
            pieces.append(offset)
        if part:
            pieces.append(F.date_format(wall, strftime_to_spark(part)))
    return F.when(c.isNotNull(), F.concat(*pieces) if len(pieces) > 1 else pieces[0])


def ts_micros(c, dtype: str = "timestamp") -> Column:
    """Microseconds since 1970-01-01 for an instant, or for a wall clock (NTZ) read as
    UTC. Monotone in its input and independent of the session zone."""
    c = _col(c)
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c)
    return F.unix_micros(c)


def utc_wall_clock(c) -> Column:
    """Instant to its UTC wall clock as TIMESTAMP_NTZ, whatever the session zone."""
    secs = F.unix_micros(_col(c)).cast("decimal(20,0)") / F.lit(1_000_000)
    return _epoch_ntz() + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def decode_epoch_ms(c, ntz: bool = True) -> Column:
    """Epoch milliseconds to ``struct(ts, raw_ms)``.

    Inside years 1..9999 ``ts`` is set and ``raw_ms`` is NULL; outside, the number is kept
    in ``raw_ms`` instead (a timestamp there cannot be collected to Python).
    """
    ms = _col(c).cast("long")
    inside = ms.between(MIN_EPOCH_MS, MAX_EPOCH_MS)
    if ntz:
        secs = (ms.cast("decimal(20,0)") / F.lit(1000)).cast("decimal(18,6)")
        ts = _epoch_ntz() + F.make_dt_interval(secs=secs)
    else:
        ts = F.timestamp_millis(ms)
    return F.struct(
        F.when(inside, ts).alias("ts"),
        F.when(ms.isNotNull() & ~inside, ms).alias("raw_ms"),
    )


def hour_of_day(c) -> Column:
    """Fractional hour of a wall clock: hour + minute / 60, seconds ignored. Give an instant
    as ``utc_wall_clock(instant)``; as it is, Spark would take its hour in the session zone."""
    c = _col(c)
    return F.hour(c) + F.minute(c) / F.lit(60.0)


def diurnal_baseline(c, mean: float = 22.0, amplitude: float = 5.0, phase: float = 6.0) -> Column:
    """``mean + amplitude * sin(2*pi/24 * (hour - phase))``; with the defaults the
    maximum is at 12:00 UTC."""
    return F.lit(mean) + F.lit(amplitude) * F.sin(
        F.lit(2 * math.pi / 24) * (hour_of_day(c) - F.lit(phase))
    )
