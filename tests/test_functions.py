"""Scalar functions: rounding, clamping, locale numbers, booleans, ids, epoch, baseline."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from sensorlake.functions import (
    clamp,
    decode_epoch_ms,
    diurnal_baseline,
    fixed_text,
    format_bool,
    format_number,
    norm_name,
    parse_bool,
    parse_number,
    round2,
    stable_uuid,
    utc_wall_clock,
)
from sensorlake.functions.time import ntz_literal
from sensorlake.operators.keys import hash_range, token_splits, unexpired, with_expiry
from sensorlake.schema import TOPIC


def one(spark, expr_fn, data, schema):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(expr_fn().alias("x")).collect()]


def test_round2_half_up(spark):
    assert one(spark, lambda: round2("v"), [(2.675,), (1.005,), (-2.675,)], "v double") == [2.68, 1.01, -2.68]


def test_clamp_keeps_null_and_is_idempotent(spark):
    data = [(None,), (-5.0,), (500.0,), (2500.0,), (1000.0,)]
    got = one(spark, lambda: clamp("v", 400, 2000), data, "v double")
    assert got == [None, 400.0, 500.0, 2000.0, 1000.0]
    again = one(spark, lambda: clamp(clamp("v", 400, 2000), 400, 2000), data, "v double")
    assert again == got


def test_parse_and_format_numbers(spark):
    got = one(spark, lambda: parse_number("s", ",", "."), [("1.234,5",), (" 7,25 ",), ("abc",), (None,)], "s string")
    assert got == [1234.5, 7.25, None, None]
    got = one(spark, lambda: format_number("v", 5), [(8.17,), (1.0,), (0.123456,), (None,)], "v double")
    assert got == ["8.17", "1", "0.12346", None]
    got = one(spark, lambda: format_number("v", 2, ",", "."), [(1234567.891,), (-1234.5,)], "v double")
    assert got == ["1.234.567,89", "-1.234,5"]


def test_booleans(spark):
    got = one(spark, lambda: parse_bool("s", "yes,no"), [("YES",), ("no",), (" Yes ",), ("maybe",), (None,)], "s string")
    assert got == [True, False, True, None, None]
    assert one(spark, lambda: format_bool("b", "1,0"), [(True,), (False,), (None,)], "b boolean") == ["1", "0", None]


def test_norm_name():
    assert norm_name("PM25") == "pm25" and norm_name('"PM25"') == "PM25" and norm_name('"a""b"') == 'a"b'


def test_stable_uuid_is_md5_layout(spark):
    got = one(spark, lambda: stable_uuid("t", "p", "o"), [(TOPIC, 3, 42)], "t string, p int, o long")[0]
    h = hashlib.md5(f"{TOPIC}|3|42".encode()).hexdigest()
    assert got == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def test_decode_epoch_ms_bounds(spark):
    data = [(0,), (253402300799999,), (253402300800000,), (-62135596800000,), (-62135596800001,), (None,)]
    df = spark.createDataFrame(data, "ms long").select(decode_epoch_ms("ms").alias("d"))
    got = [(r.d.ts, r.d.raw_ms) for r in df.collect()]
    assert got[0] == (datetime(1970, 1, 1), None)
    assert got[1][0] == datetime(9999, 12, 31, 23, 59, 59, 999000)
    assert got[2] == (None, 253402300800000)
    assert got[3] == (datetime(1, 1, 1), None)
    assert got[4] == (None, -62135596800001)
    assert got[5] == (None, None)


def test_baseline_peaks_at_noon(spark):
    hours = [(datetime(2024, 1, 1, h, 0),) for h in range(24)]
    got = one(spark, lambda: diurnal_baseline("t"), hours, "t timestamp_ntz")
    assert max(range(24), key=lambda h: got[h]) == 12 and abs(got[12] - 27.0) < 1e-9 and abs(got[0] - 17.0) < 1e-9


def test_utc_wall_clock(spark):
    got = one(spark, lambda: utc_wall_clock("t"), [(datetime(2024, 3, 31, 2, 30),)], "t timestamp")
    assert got == [datetime(2024, 3, 31, 2, 30)]


def test_hash_ranges_disjoint_and_cover(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    parts = [set(r.k for r in hash_range(df, "k", b, e).collect()) for b, e in token_splits(5)]
    assert sum(len(p) for p in parts) == 5000 and set().union(*parts) == set(range(5000))


def test_expiry(spark):
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 3600), (2, datetime(2024, 1, 1), None), (3, datetime(2024, 1, 1), 10)],
        "id int, ts timestamp_ntz, ttl int",
    )
    e = with_expiry(df, "ts", "ttl")
    alive = unexpired(e, ntz_literal(datetime(2024, 1, 1, 0, 30)))
    assert sorted(r.id for r in alive.collect()) == [1, 2]


def test_format_ts_in_a_zone(spark):
    from sensorlake.functions import format_ts

    rows = [(datetime(2024, 1, 15, 12, 0, 0),), (datetime(2024, 7, 15, 12, 0, 0, 250000),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp")  # session zone is UTC: these are UTC instants
    got = [r[0] for r in df.select(format_ts("t", "%Y-%m-%d %H:%M:%S%z", tz="Europe/Berlin")).collect()]
    assert got == ["2024-01-15 13:00:00+0100", "2024-07-15 14:00:00+0200", None]
    got = [r[0] for r in df.select(format_ts("t", "%H:%M%z", tz="America/St_Johns")).collect()]
    assert got[:2] == ["08:30-0330", "09:30-0230"]
    ntz = spark.createDataFrame(rows, "t timestamp_ntz")
    assert ntz.select(format_ts("t", "%Y-%m-%dT%H:%M:%S.%f%z", ntz=True)).first()[0] == "2024-01-15T12:00:00.000000+0000"


def test_fixed_text_is_exact(spark):
    """Against Python's correctly rounded formatting: ties, shortest forms at half a unit, carries,
    signs, the largest and smallest numbers."""
    import random

    rng = random.Random(4)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 0.125, 0.375, 0.15, 0.25, 1.005, 2.675, 9.995, 0.9999999999995, 5e-324, 1e-310, 1e300]
    values += [2.0**52 + 0.5, 2.0**53, 2.0**62, 123456789012345.67, 99999999.5, -1e-9, 0.045, 1e15 + 0.3]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 16) for _ in range(300)]
    values += [rng.randrange(10**7) / 10**k for k in range(1, 8) for _ in range(40)]
    values += [(2 * rng.randrange(10**6) + 1) / 2**k for k in range(1, 14) for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 1, 2, 3, 5, 12, 15):
        got = df.select("v", fixed_text("v", n).alias("t")).collect()
        assert [(r.v, r.t) for r in got if r.t != f"{r.v:.{n}f}" and abs(r.v) < 2**63] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r[0] for r in odd.select(format_number("v", 3)).collect()] == [None, "NaN", "Infinity"]
