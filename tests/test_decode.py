"""Golden decode table, timestamp layouts, encode/decode round trip, quarantine split."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F

from sensorlake.functions.time import iso_ts, parse_ts
from sensorlake.schema import ENVELOPE, METRICS, TOPIC
from sensorlake.sources.messages import decode_messages, encode_messages, split_malformed

GOLDEN = [
    ('{"pm25":8.17,"pm10":15,"co2":420.0,"timestamp":"2025-07-09T20:06:34.672000"}', "ok"),
    ("not json", "null"),
    ("[]", "null"),
    ('[{"pm25":1},{"pm25":2}]', "null"),
    (None, "null"),
    ('{"pm25":"abc","pm10":2.5,"timestamp":"bad"}', "partial"),
    ('{"pm25":"7.5","extra":1}', "quoted"),
    ('{"pm25":1e40,"pm10":"NaN"}', "special"),
]


def envelopes(spark, bodies):
    rows = [
        (None, None if b is None else b.encode("utf-8"), TOPIC, 0, i, None, 0)
        for i, b in enumerate(bodies)
    ]
    return spark.createDataFrame(rows, ENVELOPE)


def test_golden_decode(spark):
    env = envelopes(spark, [b for b, _ in GOLDEN])
    out = decode_messages(env, keep=["offset"]).withColumn("ts", parse_ts("timestamp")).orderBy("offset").collect()
    assert len(out) == len(GOLDEN)  # never drops a message
    ok = out[0]
    assert abs(ok.pm25 - 8.17) < 1e-6 and ok.pm10 == 15.0 and ok.co2 == 420.0
    assert ok.temperature is None and ok.humidity is None
    assert ok.ts == datetime(2025, 7, 9, 20, 6, 34, 672000)
    for r in out[1:5]:
        assert all(getattr(r, m) is None for m in METRICS) and r.timestamp is None
    partial = out[5]
    assert partial.pm25 is None and partial.pm10 == 2.5 and partial.ts is None
    assert out[6].pm25 is None
    special = out[7]
    assert math.isinf(special.pm25) and math.isnan(special.pm10)


def test_timestamp_layouts(spark):
    accepted = [
        "2025-07-09T20:06:34",
        "2025-07-09T20:06:34.672594",
        "2025-07-09T20:06:34+02:00",
        "2025-07-09T20:06:34Z",
        "2025-07-09",
        " 2025-07-09 ",
    ]
    rejected = ["1752091594", "20250709", "bad"]
    df = spark.createDataFrame([(s,) for s in accepted + rejected], "s string")
    got = [r.t for r in df.select(parse_ts("s").alias("t")).collect()]
    assert all(t is not None for t in got[: len(accepted)])
    assert all(t is None for t in got[len(accepted):])
    assert got[2] == datetime(2025, 7, 9, 18, 6, 34)  # offset honoured (session zone UTC)


def test_iso_ts_like_python(spark):
    ts = [datetime(2025, 7, 9, 20, 6, 34), datetime(2025, 7, 9, 20, 6, 34, 5), datetime(2025, 1, 2, 3, 4, 5, 672000)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp")
    got = [r.s for r in df.select(iso_ts("t").alias("s")).collect()]
    assert got == [t.isoformat() for t in ts]


def test_encode_decode_round_trip(spark):
    rows = [(8.17, 15.0, 420.0, 22.5, 45.0, datetime(2025, 7, 9, 20, 6, 34, 672594)),
            (0.0, None, 2000.0, -3.25, 90.0, datetime(2025, 7, 9, 20, 6, 39))]
    df = spark.createDataFrame(rows, "pm25 float, pm10 float, co2 float, temperature float, humidity float, timestamp timestamp")
    env = encode_messages(df, offset=F.monotonically_increasing_id())
    back = decode_messages(env).withColumn("timestamp", parse_ts("timestamp"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_split_partitions_input(spark):
    bodies = [b for b, _ in GOLDEN] + ['{"pm25":1.0,"timestamp":"2025-07-09T20:06:34"}']
    env = envelopes(spark, bodies)
    good, bad = split_malformed(env, keep=["offset"])
    g = {r.offset for r in good.collect()}
    b = {r.offset: r.reason for r in bad.collect()}
    assert g.isdisjoint(b) and g | set(b) == set(range(len(bodies)))
    assert b[4] == "null_body" and b[1] == "malformed_json" and b[2] == "malformed_json"
    assert b[5] == "malformed_json"  # wrong type in one field fills the corrupt column
    assert g == {0, 7, 8}  # 1e40 and "NaN" decode to Infinity and NaN: not malformed
    assert bad.where("offset = 1").first().body == "not json"
